"""Source divergence against a plain version with every term and pair."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, least=3, ranks=200):
    groups, documents = {}, {}
    for _, text, lang, source in rows:
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.setdefault((lang or "", source or ""), Counter()).update(found)
        documents.setdefault(lang or "", Counter()).update(set(found))
    out = []
    for lang, seen in documents.items():
        kept = [t for t, n in seen.items() if n >= least]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        own[None] = sum(own.values(), Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in own.items()}
        f = lambda s, o, t: (share[s][t] - share[o][t]) ** 2 // share[o][t]
        for s in own.keys() - {None}:
            pairs = [(sum(f(s, o, t) for t in kept), o) for o in own if o not in (None, s)]
            terms = [(f(s, None, t), t) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(best, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_awkward_rows(docs, plain):
    assert got(source_divergence(docs)) == plain_divergence(plain)
    assert got(source_divergence(docs, least=1, ranks=3)) == plain_divergence(plain, 1, 3)


def test_sources_that_share_some_terms_all_and_none(spark):
    texts = {"a": "one two two Three", "b": "one ONE été été", "c": "", "d": "日本 one zwei", "e": "12 34 !?"}
    rows = [(k, texts[s] + " " + " ".join(f"w{chr(97 + k % j)}" for j in range(1, 6)), lang, s) for k, (s, lang) in enumerate((s, lang) for s in texts for lang in ("en", "de") for _ in range(4))]
    rows += [(99, None, "xx", "a"), (99, "", "xx", "b"), (99, "lone", "yy", None)]
    assert got(source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))) == plain_divergence(rows)


def test_counts_are_the_same_however_tasks_gather_them(spark, docs, plain, monkeypatch):
    monkeypatch.setattr("panelforge.llm.divergence.GATHERED", 1)
    assert got(source_divergence(docs.repartition(5))) == plain_divergence(plain)


def test_empty_table(spark, empty):
    assert source_divergence(empty).collect() == []


@pytest.mark.parametrize("c", [0, 5, 10**12])
def test_shares_are_exact_where_longs_end(spark, c):
    from panelforge.llm.divergence import share

    row = spark.range(1).selectExpr(f"{c}L AS c", "7L AS n", "1000000000000L AS v").select(share(F.col("c"), "n", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (c + 1) // (7 + 10**12)
