from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from duck import assert_same

import corpus_pipeline
from rasterloom.llm import bpe, common, langid, mixing
from rasterloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_queries_without_sql_keep_their_contract(spark, sf_dir):
    """op1, op2, op7 and op8 as registered: one row per document, columns, folds, and what follows from them."""
    texts = {r["doc_id"]: r["text"] for r in common.documents(spark, sf_dir).select("doc_id", "text").collect()}
    found = {name: {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()} for name in sorted(set(QUERIES) - set(ORACLE_SQL))}
    assert set(found) == {"op1_lm_score", "op2_bpe", "op7_toxicity", "op8_language"}
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).splitlines())}, special_tokens={})
    learned = Counter(w for i, t in texts.items() if fold(i, 5) != 1 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(learned.values()), len(learned)
    for rows in found.values():
        assert set(rows) == set(texts)
    for i, text in texts.items():
        one, two, seven, eight = (found[k][i] for k in sorted(found))
        words = [*(text or "").encode().lower().split(), b""]
        assert (one["held_out"], one["n_tokens"], one["n_known"], one["train_tokens"]) == (fold(i, 5) == 1, len(words), sum(learned[w] > 0 for w in words), n)
        assert math.isclose(one["base_score"], sum(math.log10((learned[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        ids = coder.encode_ordinary(text or "")
        assert (two["n_tokens"], two["ids_sha256"], two["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert seven["held_out"] == (fold(i, 5) == 0)
        assert 0 <= seven["score"] <= 1
        assert seven["predicted"] == int(seven["score"] >= 0.5)
        assert eight["held_out"] == (fold(i, 4) == 2)
        assert 0 <= eight["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert eight["lang_pred"] == "und"


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def brute(spark, docs):
    """The stages in plain loops over collected rows."""
    from test_jaccard import components_of, sets_of

    model = langid.fit(docs.where(common.fold_of("doc_id", 4) != 2))
    rows = docs.collect()
    _, _, rejected = model.predict([r["text"] for r in rows])
    rows = [r for r, bad in zip(rows, rejected, strict=True) if not bad]
    best = {}
    for r in rows:
        key = (r["text"] or "").encode().lower()
        best[key] = max(best.get(key, -1), r["doc_id"])
    rows = [r for r in rows if r["doc_id"] in set(best.values())]
    component = components_of(sets_of([(r["doc_id"], r["text"]) for r in rows], 5), 80, 100)
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, docs.schema)).collect()
    copies = {r["doc_id"]: r["copies"] for r in plan}
    texts = {r["doc_id"]: r["text"] for r in rows}
    coder = bpe.shared_model(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return sorted((i, tuple(coder.encode(texts[i] or ""))) for i, n in copies.items() for _ in range(n))


def test_run_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(spark, spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in found) == want


def test_stages_keep_columns_and_take_empty_tables(spark, clashing, no_docs, odd_docs):
    frames = {"clashing": clashing, "none": no_docs, "odd": odd_docs}
    for name, frame in frames.items():
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, "")
            rows = out.count()
            assert rows <= 2 * frame.count(), name
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == frame.columns
