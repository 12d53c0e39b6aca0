import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from sparkfolio.llm import kneser_ney, mixing, secret_scan
from sparkfolio.llm.common import staged
from sparkfolio.session import written_so_far
from tests.llm.test_kneser_ney import brute_cutoffs, unseen_keys
from tests.llm.test_mixing import fill
from tests.llm.test_ngram_join import brute


def test_stages_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for name, stage in p.STAGES:
        outs.append(staged(stage(spark, outs[-1], path), "stage"))
    raw, good, single, clean, mixed, coded = outs
    assert all(x.columns == columns for x in outs[1:5])

    kept = {r.doc_id for r in kneser_ney.classify(raw, kneser_ney.trusted_of(spark.read.parquet(f"{path}/labels.parquet"))).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute(rows, 5, 80)}

    before, after = ({r.doc_id: r for r in x.collect()} for x in (single, clean))
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert r.n_chars == len(r.text) and not secret_scan.base_spans(r.text, secret_scan.long_runs(r.text, 16))
        assert r.text == before[k].text or "<secret>" in r.text

    size = {k: len(re.findall("[^\x20\x09-\x0D]+", r.text)) for k, r in after.items()}
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes = Counter()
    for k, r in after.items():
        sizes[r.source] += size[k]
    for source, target in fill(sizes).items():
        mine = [k for k, r in after.items() if r.source == source]
        assert abs(sum(copies[k] * size[k] for k in mine) - target) <= max(size[k] for k in mine)
    assert max(copies.values()) <= 2

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter(map(tuple, coded.collect()))
    want = Counter()
    for r in mixed.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert got == want


def test_the_quality_stage_rejects_what_brute_force_cutoffs_reject(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{x}.parquet") for x in ("documents", "labels"))
    rows = kneser_ney.classify(docs, kneser_ney.trusted_of(labels)).collect()
    cutoff = brute_cutoffs(rows, unseen_keys(spark, docs, kneser_ney.trusted_of(labels), 1_000_000))
    gone = {r.doc_id for r in rows if r.n_tokens <= 1 or r.perplexity >= cutoff(r.lang)}
    left = {r.doc_id for r in p.quality(spark, docs, path).collect()}
    assert left == {r.doc_id for r in rows} - gone and 10 < len(gone) < 500


def test_a_run_leaves_its_result_only(spark):
    mark = written_so_far(spark)
    other = staged(spark.range(3), "other")
    got = p.run(spark, "/root/testdata/sf0.001")
    assert written_so_far(spark) == mark + 2 and got.count() > 100 and other.count() == 3


def test_nulls_repeats_empty(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", "en", "t", 0),
            (3, "token = abcdefgh12345 x y z w", None, "s", None), (4, "w " * 3000, "en", None, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    for frame in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            frame = staged(stage(spark, frame, "/root/testdata/sf0.001"), "stage")
        assert "ids_sha256" in frame.columns
    assert p.mix(spark, docs, "").columns == docs.columns and mixing.mix(docs).count() == len(rows)
