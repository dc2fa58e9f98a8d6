"""Spelling variants, tokenizer alignment and suffix arrays against plain versions; op1 through its query."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import queries, spelling, suffix_dedup, token_alignment

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(n, ratio):
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in found.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(found[w]), n[form[w]] if w in form else None)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_groups_equal_a_plain_version(llm):
    rng = random.Random(8)
    n = {}
    for _ in range(60):
        word = "".join(rng.choices("abcé", k=rng.randint(4, 9)))
        n[word] = rng.choice([2, 30, 400, 5000])
        for _ in range(12):  # words one or two edits away, small alphabet: many ties and repeats
            w = list(word)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice("abcé")], [w[k], rng.choice("abcé")]])
            if len(w) >= 4:
                n.setdefault("".join(w), rng.choice([2, 2, 3, 30, 300]))
    long = "xyz" * 40
    n |= {"a" * 9: 500, "a" * 10: 40, "a" * 8: 3, long: 900, long[:50] + "q" + long[51:]: 8, long + "x": 9, "b" * 32: 700, "b" * 33: 5}
    got = as_dict(spelling.group(llm.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain_forms(n, 10)
    assert as_dict(spelling.group(llm.createDataFrame([], "word string, n long"))) == {}


def test_spelling_query_over_documents(llm, documents, tmp_path):
    rng = random.Random(4)
    words = ["thousand", "thousend", "wonderful", "Überall", "ÜBERALL", "straÃen", "l'immense", "immenses"]
    rows = [(i, " ".join(rng.choices(words, weights=[60, 2, 60, 30, 2, 2, 20, 3], k=150))) for i in range(20)]
    rows += [(20, None), (21, ""), (None, "thousand thousand thousands"), (3, rows[3][1]), (22, "x" * 3000 + " " + "x" * 3000)]
    path = str(tmp_path)
    documents(rows).write.parquet(f"{path}/documents.parquet")
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    assert as_dict(queries.queries()["op11_spelling"](llm, path)) == plain_forms({w: c for w, c in n.items() if c >= 2}, 10)


def test_pivots_are_disjoint_and_lightest():
    rng = np.random.default_rng(2)
    weights = rng.integers(0, 50, (200, 9))
    for row, (a, b) in zip(weights, spelling.pivots(weights)):
        assert b - a >= 2 and row[a] + row[b] == min(row[i] + row[j] for i in range(9) for j in range(i + 2, 9))


def plain_alignment(aligner, rows):
    info, count = [], Counter()
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        a = aligner.encode_a(" " + text).tolist() if text else []
        b = aligner.encode_b(text) if text else []
        pa, pb = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
        if not text or b"".join(pa) != data or b"".join(pb) != data:
            info.append((doc_id, 0, 0, 0, [], ""))
            continue
        ea, eb = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        both = sorted(set(ea) & set(eb))
        groups, at, bt = [], 0, 0
        for end in both:
            x, y = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[at:x])) + "|" + ",".join(map(str, b[bt:y])))
            at, bt = x, y
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if max(ea[i] - len(pa[i]), eb[j] - len(pb[j])) < min(ea[i], eb[j])]
        info.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    return sorted((str(d), na, nb, g, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), s) for d, na, nb, g, ls, s in info)


def test_alignment_equals_a_plain_version(llm, documents, monkeypatch):
    rng = random.Random(6)
    letters = list("abcdeé ß  \n\t'’日本😀") + ["the ", "ing", "<s>", "<|endoftext|>", "2024", "ﬁ"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(1, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "with ▁ inside"), (203, " "), (None, "no id"), (5, rows[5][1]), (204, "a long text, ending in blanks  " * 40)]
    import public_tokenizers

    paths = (*queries.tokenizer_paths(), str(public_tokenizers.path(queries.PIECE_FILE)))
    found = token_alignment.alignment(documents(rows).repartition(5), *paths)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect())
    assert got == plain_alignment(token_alignment.Aligner(*paths), rows)
    assert token_alignment.alignment(documents([]), *paths).count() == 0


def test_runs_are_found_by_probing():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = np.cumsum([rng.randint(1, 3) for _ in range(n)]).tolist()
        b = sorted(set(a[:-1]) ^ set(rng.sample(range(1, a[-1] + 1), min(a[-1], rng.randint(0, 6)))) | {a[-1]})
        i = rng.randrange(len(a))
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k:
                assert token_alignment.run_length(a, b, i, j) == k


def test_written_groups_keep_ids_of_any_width(monkeypatch):
    aligner = object.__new__(token_alignment.Aligner)
    monkeypatch.setattr(token_alignment, "encoder", lambda *a: None)
    monkeypatch.setattr(token_alignment, "_pieces", lambda path: type("Model", (), {"encode": None}))
    monkeypatch.setattr(token_alignment, "byte_level_bytes", lambda path: [b"x"] * 12_000)
    monkeypatch.setattr(token_alignment, "piece_bytes", lambda path: [b"x"] * 150)
    aligner.__init__("a", None, "b")
    assert isinstance(aligner.written, np.ndarray)   # looked up for all tokens at once
    a, b = np.array([0, 11_999, 7]), np.array([149, 0, 10])
    got = aligner.digest(a, b, np.array([False, True, True]), np.array([True, False, True]))
    assert got == hashlib.sha256(b"0,11999|149;7|0,10").hexdigest()


def test_suffix_arrays():
    rng = random.Random(9)
    for _ in range(30):
        pieces = [bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
        ends = np.repeat(np.flatnonzero(text == 255), [len(p) + 1 for p in pieces])
        order = suffix_dedup.suffix_array(text, ends)
        rest = [text[i:ends[i] + 1].tobytes() for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (rest[i], i))
        shared = suffix_dedup.common_prefixes(text, ends, order)
        for k in range(1, len(order)):
            x, y = rest[order[k - 1]][:-1], rest[order[k]][:-1]
            assert shared[k] == next((m for m in range(min(len(x), len(y))) if x[m] != y[m]), min(len(x), len(y)))


def plain_removal(rows, length):
    held = Counter()
    for _, text in rows:
        data = (text or "").encode()
        held.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if held[data[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((str(doc_id), len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"wide": 1, "shard_bytes": 3000, "range_strings": 300}])
def test_repeats_go_and_nothing_else(llm, documents, sizes):
    rng = random.Random(7)
    fresh = lambda n: "".join(rng.choices("abcdefgh é日 ", k=n))
    passage, edge, copy = fresh(700), fresh(400), fresh(1500)
    rows = [(i, fresh(rng.randint(0, 900)) + (passage[rng.randint(0, 100):] if i % 3 == 0 else "") + fresh(300)) for i in range(40)]
    rows += [(100, copy), (101, copy), (101, copy), (102, copy[:700] + "#" + copy[701:]), (103, fresh(50) + edge.encode()[:399].decode(errors="ignore")),
             (104, edge), (105, "a" * 3000), (106, "xy" * 200), (107, "xy" * 199 + "x"), (108, None), (109, ""), (None, fresh(600)),
             (110, fresh(200) + passage + fresh(20) + passage), (111, "a" * 399)]
    found = suffix_dedup.without_repeats(documents(rows).repartition(6), 400, **sizes)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == plain_removal(rows, 400)
    assert suffix_dedup.without_repeats(documents([]), 400).count() == 0


def test_a_repeated_piece_is_one_row_of_few_stretches(llm, monkeypatch):
    passage = "".join(chr(97 + i * i % 23) for i in range(3000)) + "".join(chr(97 + i * 7 % 26) for i in range(300))
    rows = [(i, f"{i:03d}" * 40 + passage + f"{i * 7:03d}" * 40) for i in range(30)]
    seen, made = [], suffix_dedup._repeated_pieces
    monkeypatch.setattr(suffix_dedup, "_repeated_pieces", lambda *a: seen.append(made(*a)) or seen[-1])
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.without_repeats(docs, 400, wide=3, shard_bytes=2_000, range_strings=40)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()) == plain_removal(rows, 400)
    pieces = seen[0].collect()
    assert pieces and len({bytes(r.piece) for r in pieces}) == len(pieces)   # not one for each range that holds its strings
    assert all(b > a + 1 for r in pieces for a, b in zip(r.stops, r.starts[1:]))


def test_url_query_blocks_a_labelled_host_family(llm, tmp_path):
    path = str(tmp_path)
    pages, labels = [], []
    for i in range(600):
        spam = i % 6 == 0
        host = f"{'m.' if i % 4 else ''}casino-win.example.com" if spam else f"{'m.' if i % 4 else ''}news.example.com"
        pages.append((i, f"https://{host}/en/{i}" if i % 50 else f"HTTPS://{host}/de/{i}", "x"))
        labels.append((i, 0 if spam else 1, 0))
    pages += [(700, None, None), (701, "no scheme", ""), (702, "https://m.casino-win.example.com/en/9 9?a=1", None), (703, "http://sub.example.org/es/3", None)]
    llm.createDataFrame(pages, "page_id long, url string, host string").write.parquet(f"{path}/pages.parquet")
    llm.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = {r.page_id: r for r in queries.queries()["op1_url_filter"](llm, path).collect()}
    assert len(got) == len(pages)
    for i in range(600):
        if i % 50:
            assert got[i].verdict == ("block" if i % 6 == 0 else "allow"), got[i]
    assert got[702].verdict == "block" and got[702].rule is None and "casino-win" in got[702].mined_rule
    assert got[703].verdict == "block" and got[703].rule == "example.org/es/"
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (700, 701)] == [("", "", "allow")] * 2
    empty = str(tmp_path / "none")
    llm.createDataFrame([], "page_id long, url string").write.parquet(f"{empty}/pages.parquet")
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert queries.queries()["op1_url_filter"](llm, empty).count() == 0


def test_tied_url_rules_take_the_first_name(llm):
    from sheetwise.llm import url_rules

    rules = llm.createDataFrame([(f"host=h.net{s}", ["host=h.net", *([s] if s else [])], 0.9, 0.1, "host=h.net") for s in ("", "seg1=a", "seg2=b")],
                                "rule_id string, tokens array<string>, confidence double, support double, key string")
    sets = llm.createDataFrame([("u", ["host=h.net", "seg1=a", "seg2=b"])], "set string, tokens array<string>")
    assert [(r.mined_rule, r.confidence) for r in url_rules.match(sets, rules).collect()] == [("host=h.net", 0.9)]
