"""The pipeline's stages, each against a plain version on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sheetwise.llm import queries, secret_index, simhash_anchor


@pytest.fixture(scope="module")
def corpus(llm):
    rng = random.Random(12)
    words = {"en": "the of and stone river with house walking".split(), "fr": "le la été avec rivière maison où être".split()}
    rows = []
    for i in range(120):
        k = ("en", "fr")[i % 2]
        text = " ".join(rng.choices(words[k], k=rng.randint(30, 200)))
        rows.append((i, text, k, f"src{i % 5}"))
    rows += [(200, rows[0][1], "en", "src0"), (201, rows[0][1] + " token=abcdef123", "en", "src0"), (202, "Привет мир", None, "src1"), (203, None, None, None)]
    return llm.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(llm, corpus):
    docs, out = corpus, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secrets", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(llm, docs, "")
        rows = after.collect()
        out[name] = rows
        if name != "pack":
            assert after.columns == corpus_pipeline.COLUMNS
            docs = llm.createDataFrame(rows, after.schema)
    ids = [r.doc_id for r in out["language"]]
    assert 202 not in ids and 203 not in ids and set(range(120)) | {200, 201} == set(ids)
    fps = {r.doc_id: simhash_anchor.fingerprint(r.text, 3) for r in out["language"]}
    kept = {r.doc_id for r in out["near_dedup"]}
    assert 200 not in kept and kept <= set(ids)
    for a in set(ids) - kept:
        assert any((fps[a] ^ fps[b]).bit_count() <= 2 for b in ids if b < a)
    before = {r.doc_id: r for r in out["near_dedup"]}
    for r in out["secrets"]:
        assert not secret_index.scan_segment([r.text], secret_index.RULES)[0] and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id].text or secret_index.scan_segment([before[r.doc_id].text], secret_index.RULES)[0]
    texts = {r.doc_id: r.text for r in out["secrets"]}
    assert all(r.text == texts[r.doc_id] for r in out["mix"]) and max(sum(r.doc_id == i for r in out["mix"]) for i in texts) <= 3
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_paths()[0])
    n = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert sum(r.length for r in out["pack"]) == sum(n[r.doc_id] for r in out["mix"])
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in out["pack"])


def test_near_dedup_broadcasts_no_visits(llm, corpus, monkeypatch, capsys):
    stars = simhash_anchor.stars
    monkeypatch.setattr(simhash_anchor, "stars", lambda links: (links.explain(), stars(links))[1])
    assert corpus_pipeline.near_dedup(llm, corpus, "").count() == 123  # 200 has the text of 0
    assert "Broadcast" not in capsys.readouterr().out


def test_run_on_an_empty_table(llm, corpus, tmp_path):
    corpus.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_run(llm, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(llm, str(tmp_path)).count() > 100
