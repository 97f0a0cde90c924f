import pytest
from pyspark.sql import functions as F

from flowspark.operators import rules
from flowspark.operators.fusion import final_decision, fuse_votes, fused_score, model_confidence
from flowspark.operators.rules import DEFAULTS, RULES, rule_settings, score_rules
from flowspark.plans.adapters import flows_from_lineitem

SF = "/root/testdata/sf0.001"
ORDER = ["ts_us", "row_id"]


def scored(spark, **kw):
    flows = flows_from_lineitem(spark, SF)
    return {r.row_id: (r.rules_score, r.rules_reasons) for r in score_rules(flows, order=ORDER, **kw).collect()}


def test_hot_sources_score_like_ordinary_ones(spark, request):
    plain, by_port = scored(spark), scored(spark, scope=["dst_port"])
    request.getfixturevalue("force_hot")
    assert scored(spark) == plain
    assert scored(spark, scope=["dst_port"]) == by_port


def test_rows_without_a_source_stay_apart(spark, monkeypatch):
    """Many rows without a source are no hot key: nothing but their HTTP groups has to stay together."""
    rows = [(None, f"10.0.0.{i % 40}", 80, float(i), 0.1, 10.0) for i in range(1200)]
    rows += [("1.1.1.1", "10.0.0.1", 80, float(i), 0.1, 10.0) for i in range(40)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, at double, flow_duration double, flow_byts_per_s double")
    found, look = [], rules.hot_keys

    def noted(*args):
        found.append(look(*args))
        return found[-1]
    monkeypatch.setattr(rules, "hot_keys", noted)
    spark.conf.set("spark.flowspark.hotMinRows", "500")
    try:
        got = score_rules(df, order=["at"], keep_masks=True).groupBy("src_ip").agg(
            F.count_if("R17").alias("brute"), F.count_if("R22").alias("spikes"), F.count_if("R10").alias("scans")).collect()
    finally:
        spark.conf.unset("spark.flowspark.hotMinRows")
    assert found == [None]
    assert {r.src_ip: tuple(r)[1:] for r in got} == {None: (1200, 0, 0), "1.1.1.1": (40, 0, 0)}


def test_every_rule_marks_some_rows_and_spares_others(spark):
    flows = flows_from_lineitem(spark, "/root/testdata/sf0.01")
    r = score_rules(flows, order=ORDER, keep_masks=True).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in RULES]).first()
    assert [k for k in RULES if not 0 < r[k] < r["n"]] == []


def one(spark, columns, **kw):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)).withColumn("at", F.lit(0))
    return score_rules(df, kw.pop("settings", None), order=["at"], **kw).first()


def test_wide_names_units_and_missing_columns(spark):
    r = one(spark, {"Flow Duration": 5_000_000.0, "Flow Packets/s": 300.0, "Protocol": 6, "Destination Port": 80})
    # 300 packets/s; protocol 6 is no known name; no previous row, no bytes.
    assert r.rules_reasons.split("; ") == [RULES["R01"][2], RULES["R37"][2]] and r.rules_score == 50
    known = one(spark, {"Flow Duration": 5_000_000.0, "Flow Packets/s": 300.0, "Protocol": 6, "Destination Port": 80}, normalize_protocol=True)
    assert known.rules_reasons == RULES["R01"][2]
    quiet = one(spark, {"Protocol": "TCP"})
    assert (quiet.rules_score, quiet.rules_reasons) == (0.0, "")


def test_http_reasons(spark):
    base = {"protocol": "tcp", "dst_port": 443, "flow_duration": 100.0, "pps": 0.5, "packet_length_mean": 60.0, "bps": 500.0}
    r = one(spark, base, settings=rule_settings(HIGH_BANDWIDTH_ABS=1e9, EXFIL_BPS_RATIO=1.0))
    assert r.rules_reasons.split("; ") == ["大带宽传输(疑似外泄)", "长时间低包速连接(疑似Slowloris/慢速DoS)", "疑似Slowloris攻击", "HTTP会话持续时间较长(低包速)"]
    fast = one(spark, {**base, "pps": 50.0}, settings=rule_settings(EXFIL_BPS_RATIO=1.0))
    assert fast.rules_reasons.endswith("HTTP会话持续时间过长")
    text_port = one(spark, {**base, "dst_port": 443.0}, settings=rule_settings(EXFIL_BPS_RATIO=1.0), integral_ports=False)
    assert "HTTP" not in text_port.rules_reasons
    assert "HTTP" in one(spark, {**base, "dst_port": 443.0}, settings=rule_settings(EXFIL_BPS_RATIO=1.0)).rules_reasons


def test_settings():
    s = rule_settings()
    assert (s.trigger_threshold, s.model_weight, s.rule_weight, s.fusion_threshold, s.mode) == (60.0, 0.85, 0.15, 0.75, "conservative")
    a = rule_settings("Aggressive ")
    assert (a.trigger_threshold, a.fusion_threshold, a.mode, a.params["SCAN_TARGETS"]) == (35.0, 0.3, "aggressive", 60.0)
    assert rule_settings("nope").profile == "baseline" and rule_settings(source="preset").params["FLOW_PPS_THRESHOLD"] == 240.0
    assert rule_settings(source="defaults").params == DEFAULTS
    m = rule_settings(metadata={"rule_profile": "aggressive", "rule_threshold": 10, "fusion_model_weight": 3, "fusion_rule_weight": 1})
    assert m.profile == "aggressive" and m.trigger_threshold == 10 and m.normalized_weights == (0.75, 0.25)
    assert rule_settings(trigger_cap=25).trigger_threshold == 25
    with pytest.raises(KeyError):
        rule_settings(NO_SUCH=1)


def test_fusion_examples(spark):
    df = spark.createDataFrame([(0.1, 10.0), (0.6, 70.0), (0.9, 95.0)], "malicious_score double, rules_score double")
    from dataclasses import replace
    half = replace(rule_settings(), model_weight=0.5, rule_weight=0.5, fusion_threshold=0.5, trigger_threshold=60.0)
    r = fuse_votes(df, half, confidence=None).orderBy("malicious_score").collect()
    assert [x.fusion_score for x in r] == pytest.approx([0.10, 0.65, 0.925])
    assert [x.fusion_decision for x in r] == [0, 1, 1] and [x.rules_triggered for x in r] == [False, True, True]
    sure = df.select(fused_score(F.col("malicious_score"), F.col("rules_score"), half, model_confidence(F.col("malicious_score"))).alias("s"))
    assert sorted(x.s for x in sure.collect()) == pytest.approx([0.10, 0.63, 0.905])


def test_final_decision_of_the_aggressive_profile(spark):
    df = spark.createDataFrame([(0.0, 20.0), (0.0, 36.0), (0.9, 0.0)], "malicious_score double, rules_score double")
    a = rule_settings("aggressive")
    r = final_decision(fuse_votes(df, a), a).orderBy("malicious_score", "rules_score").collect()
    assert [x.prediction_status for x in r] == [0, 1, 1] and r[1].fusion_status == "异常"
    b = rule_settings()
    assert [x.prediction_status for x in final_decision(fuse_votes(df, b), b).orderBy("malicious_score", "rules_score").collect()] == [0, 0, 1]
