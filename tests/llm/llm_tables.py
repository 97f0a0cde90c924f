"""Small tables for the tests of this folder."""

WORDS = ("the of and lorem ipsum dolor amet consectetur elit sed do eiusmod tempor incididunt labore magna aliqua enim minim "
         "veniam quis nostrud ullamco laboris nisi aliquip commodo duis aute irure voluptate velit esse cillum fugiat").split()
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, words string, "
              "length long, mark long, print long, component_id long")


def prose(n, seed):
    """n words that hardly repeat in runs."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 3 else str(x % 97)))
    return " ".join(out)


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those the operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), 1, True, "w", 2, 3, 4, 5) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


MESSY = [None, "", " \t\n ", "one", "Shared line of text here\n\n  SHARED LINE OF TEXT HERE  \nown", "shared line of text here\nother words",
         prose(60, 1), prose(60, 1), prose(60, 2) + "\n" + prose(60, 3), "é" * 40 + " ünïcode Wörds", "x" * 3000, prose(4000, 5)]
MESSY_IDS = [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, None, 9]
