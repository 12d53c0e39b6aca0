import math
import re

from pyspark.sql import functions as F

from sparkfolio.llm import quality_rules as q
from sparkfolio.llm.queries import op5_quality_rules


def features(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_query_against_definition(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = features(docs[r.doc_id])
        assert tuple(r[n] for n in NAMES) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_hard_texts(spark):
    texts = ["", None, "a", " \t\n", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 3000, "l\nl\n\nl\n \n é#é", "a b c d e f g h i " * 2 + "z",
             "\x85 \xa0 b c", " ".join(str(i) for i in range(20000))]
    docs = spark.createDataFrame([(1, t, None, 5) for t in texts], "doc_id long, text string, lang string, n_words int")
    got = sorted(tuple(r[n] for n in NAMES) for r in q.measure(docs).collect())
    assert got == sorted(features(t) for t in texts)


def test_binomial_tail(spark):
    def exact(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    cases = [(0, 1), (0, 300), (2, 500), (20, 3000), (300, 40000), (9_500, 1_000_000), (50, 100)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        want = 1.0 if r.k > r.n * 0.01 else exact(r.k, r.n, 0.01)
        assert math.isclose(r.p, want, rel_tol=1e-7), r


def test_cutoffs_limit_false_rejection(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bad = " ".join(f"w{i}##" for i in range(40))
    rows = [(i, good if i % 4 else bad, "en" if i % 2 else None) for i in range(6000)] + [(None, good, "de"), (1, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(6000)] + [(None, 1), (2, None), (3, 1)], "doc_id long, quality int")
    got = q.apply(docs, labels).groupBy("kept", F.col("n_symbols") > 0).count().collect()
    assert {tuple(r)[:2]: r["count"] for r in got} == {(True, False): 4501, (False, True): 1500, (False, False): 1}
    few = q.apply(docs, labels.limit(0)).filter("kept").count()
    assert few == 6001 and q.apply(docs.limit(0), labels).count() == 0
