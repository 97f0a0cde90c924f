"""Capture bytes built by hand."""

import ipaddress
import struct


def ip4(src, dst, proto, payload, options=b"", frag=0, total=None):
    ihl = 5 + len(options) // 4
    length = ihl * 4 + len(payload) if total is None else total
    head = struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, length, 1, frag, 64, proto, 0,
                       ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed)
    return head + options + payload


def ip6(src, dst, nxt, payload):
    return struct.pack(">IHBB16s16s", 6 << 28, len(payload), nxt, 64, ipaddress.ip_address(src).packed,
                       ipaddress.ip_address(dst).packed) + payload


def tcp(sport, dport, flags=0x18, win=1000, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, win, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def eth(payload, kind=0x0800, vlan=False):
    tag = struct.pack(">HH", 0x8100, 7) if vlan else b""
    return b"\1" * 6 + b"\2" * 6 + tag + struct.pack(">H", kind) + payload


def pcap(frames, order="<", nano=False, cut=0):
    """frames: (microseconds, bytes)"""
    out = struct.pack(order + "IHHIIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for us, data in frames:
        part = us % 1_000_000 * (1000 if nano else 1)
        out += struct.pack(order + "IIII", us // 1_000_000, part, len(data), len(data)) + data
    return out[:len(out) - cut] if cut else out


def _block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = len(body) + 12
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def pcapng(frames, order="<", tsresol=None):
    """frames: (ticks, bytes) at the interface's resolution (microseconds by default)"""
    out = _block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    options = b"" if tsresol is None else struct.pack(order + "HH", 9, 1) + bytes([tsresol, 0, 0, 0]) + struct.pack(order + "HH", 0, 0)
    out += _block(order, 1, struct.pack(order + "HHI", 1, 0, 65535) + options)
    for ticks, data in frames:
        out += _block(order, 6, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)
    return out
