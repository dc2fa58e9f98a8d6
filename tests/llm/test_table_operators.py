"""SimHash components, top-k, PII, URL rules and mixing against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import entropy_mix, pii_spans, simhash_anchor, url_rules, va_file

CODES = [("golay23", "golay23"), ("hamming15", "golay23", "repetition5"), ("hamming7", "hamming31")]


@pytest.mark.parametrize("code", CODES)
def test_visits_cover_every_close_pair(code):
    rng = random.Random(3)
    for name in code:
        cols, tables = simhash_anchor._patterns(name, 2)
        assert tables[0].shape[1] == 1  # perfect: one codeword within the radius
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        row, anchor, cost = simhash_anchor.visits(np.array([x, y], np.uint64).view(np.int64), 2, code)
        home = anchor[(row == 0) & (cost == 0)]
        other = anchor[row == 1].tolist()
        assert len(home) == 1 and home[0] in other and len(set(other)) == len(other)


def _slow_fingerprint(text, k):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, k, bits):
    fps = [_slow_fingerprint(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min([rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None], default=None) for g in group}
    return [(rows[i][0], fps[i], least[group[i]]) for i in range(len(rows))], group


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(1, 400))
        rows.append((i * 10, " ".join(base)))
        for c in range(rng.randint(0, 4)):
            edit = list(base)
            edit[rng.randrange(len(edit))] = "EDITED"
            rows.append((i * 10 + 1 + c, " ".join(edit if c else base)))
    return rows + [(700, None), (701, ""), (702, "\t \n"), (None, "no id"), (None, "no id"), (20, "another text with an id that is used"), (20, "another text with an id that is used")]


def test_components(llm, documents, near_rows):
    want, _ = _components(near_rows, 3, 2)
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_anchor.near_duplicates(documents(near_rows), 3, 2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash_anchor.near_duplicates(documents([]), 3, 2).count() == 0


def test_long_chains_are_one_component(llm):
    chain = [0]
    for b in range(40):  # each value two bits from the last, far from the others
        chain.append(chain[-1] ^ (1 << b) ^ (1 << (63 - b // 2)))
    fps = llm.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in chain], "fp long").distinct()
    links = simhash_anchor.near_links(fps, 2)
    roots = {r.root for r in simhash_anchor.stars(links).collect()}
    assert len(roots) == 1


def test_visits_are_never_broadcast(llm, capsys):
    simhash_anchor.near_links(llm.range(50).select(F.xxhash64("id").alias("fp")), 2).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # though Spark thinks either side small


def test_keep_one(llm, documents, near_rows):
    want, group = _components(near_rows, 3, 2)
    kept = simhash_anchor.keep_one(documents(near_rows), 3, 2).collect()
    assert len(kept) == len(set(group))
    by_group = {g: w[2] for g, w in zip(group, want)}
    assert sorted((r.doc_id for r in kept), key=repr) == sorted(by_group.values(), key=repr)
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "fp", "size", "u"}


def _top(rows, k, scale):
    valid = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(valid):
        if i is not None and i % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, (j, w) in enumerate(valid) if m != n and len(w) == len(v)))[:k]
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found)]
    return out


def test_top_k(llm):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(450)]
    rows += [(1000 + i, rows[200][1]) for i in range(300)]  # one vector in many copies
    rows += [(600, None), (700, [1.0, None] * 4), (800, [float("nan")] * 8), (900, [float("inf")] * 8), (2000, [1.0, 2.0]), (2001, [3.0, 1.0]),
             (300, rows[300][1]), (400, rng.normal(size=8).tolist()), (None, rows[100][1]), (2100, []), (2300, [0.0] * 8)]
    df = llm.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int")
    import struct

    single = [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    got = [tuple(r) for r in va_file.top_k(df, F.col("id") % 100 == 0).collect()]
    assert sorted(got, key=repr) == sorted(_top(single, 10, 1024), key=repr)
    few = llm.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in va_file.top_k(few, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert va_file.top_k(few.limit(0), F.col("id") % 100 == 0).count() == 0


def test_blocks_meet_without_broadcast(llm, monkeypatch, capsys):
    scan, seen = va_file._scan, []
    monkeypatch.setattr(va_file, "BLOCK", 20)
    monkeypatch.setattr(va_file, "QUERY_BLOCK", 2)

    def watched(pairs, k):
        pairs.explain()
        seen.append(scan(pairs, k).cache())
        return seen[-1]

    monkeypatch.setattr(va_file, "_scan", watched)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(700)] + [(9000 + i, [1.0, 2.0]) for i in range(3)]
    got = [tuple(r) for r in va_file.top_k(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0, k=3).collect()]
    assert sorted(got, key=repr) == sorted(_top(rows, 3, 1024), key=repr)
    assert "Broadcast" not in capsys.readouterr().out
    blocks = 35  # of 20 vectors; a query keeps k + 1 classes of some blocks, not of each
    assert seen[-1].filter("qid >= 0").count() < 8 * blocks * 4
    for s in seen:
        s.unpersist()


def test_top_k_of_huge_components_is_exact(llm):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 6)).tolist()) for i in range(120)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in va_file.top_k(df, F.col("id") % 100 == 0, k=3, scale=1024).collect()]
    assert sorted(got) == sorted(_top(rows, 3, 1024))


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(kinds[k][0], a, b) for a, k, b in sorted(found)]


def test_personal_data(llm, documents):
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "@", "1.2.3.4", "999.1.1.1.2.3.4", "00255.0.0.1", "1.2.3", "4242 4242 4242 4242", "4242-4242-4242-4241",
             "5" * 25, "+1 (988) 555-2485", "+1((((", "+12", "é", "😀", "12345678901234567890.1.1.1", "5555555555554444", "\n", " ", "-", ".", "37 8282246310005"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(400)]
    edge = [None, "", "7" * 100_000, "a" * 100_000, "1.1.1.1 " * 3000, "a@" + "b." * 20_000 + "c", ("9 " * 30_000), "+1" + "(" * 50_000]
    rows = list(enumerate(texts + edge + texts[:3]))
    got = pii_spans.find(documents(rows)).select("doc_id", "text", "spans").collect()
    assert len(got) == len(rows)
    base = {k.name for k in pii_spans.KINDS if k.base}
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in base] == _base_pii(r.text)
    assert pii_spans.find(documents([])).count() == 0


def test_context_and_checksums_decide(llm, documents):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 ok"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"),
            (5, "mail to a@b.de"), (6, "see a@b.de")]
    got = {r.doc_id: r.spans for r in pii_spans.find(documents(rows)).collect()}
    assert [s.kind for s in got[1]] == ["iban"] and got[2] == [] and [s.kind for s in got[3]] == ["ssn"] and got[4] == []
    assert got[5][0].score > got[6][0].score
    plan = pii_spans.find(documents(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_context_reaches_over_other_matches(llm, documents):
    rng = random.Random(6)
    listed = "SSN: 123-45-6789, 987-65-4321, 111-22-3333"
    after = "123-45-6789 987-65-4321 social security"
    parts = ["123-45-6789", "987-65-4321", " ", ", ", "ssn", " social ", "word word ", "x" * 30, "\n", "é😀"]
    texts = [listed, after, listed + " " + "x" * 40 + " 222-33-4444"] + ["".join(rng.choices(parts, k=rng.randint(2, 25))) for _ in range(300)]
    texts += ["ssn " + "123-45-6789 " * 3000]
    kind = next(k for k in pii_spans.KINDS if k.name == "ssn")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "ssn"] for r in pii_spans.find(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        near = lambda m: t[max(m.start() - 40, 0):m.start()] + "\n" + t[m.end():m.end() + 40]
        assert got[i] == [m.span() for m in re.finditer(kind.pattern, t) if re.search(rf"\b(?:{kind.words})\b", near(m).lower())], t[:200]
    assert len(got[0]) == 3 and len(got[1]) == 2 and len(got[2]) == 3


def test_an_iban_ends_where_its_country_says(llm, documents):
    iban, other = "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"
    tails = [" BIC COBADEFFXXX", " EUR now", " 2024", ", ok", "", " AND MORE"]
    rows = [(i, f"pay {x}{t}") for i, (x, t) in enumerate((x, t) for x in (iban, iban.replace(" ", "")) for t in tails)]
    got = {r.doc_id: r for r in pii_spans.find(documents([*rows, (90, f"{iban} {other} {iban}"), (91, iban.replace(" ", "") + "EUR"),
                                                          (92, "XY12 ABCD EFGH IJKL " + iban), (93, "DE89 3704 0044 0532 0130 01 EUR")])).collect()}
    found = {i: [r.text[s.start:s.end] for s in r.spans if s.kind == "iban"] for i, r in got.items()}
    assert all(found[i] == [(iban, iban.replace(" ", ""))[i >= len(tails)]] for i, _ in rows)
    assert found[90] == [iban, other, iban] and found[91] == [] and found[92] == [iban] and found[93] == []


def test_url_parts_and_listed_rules(llm):
    from sheetwise.llm.queries import URL_RULES

    cases = {None: ("", "", None), "no scheme/x": ("", "", None), "http://A.Org": ("a.org", "", None), "http://a.org/": ("a.org", "/", "org/"),
             "https://M.Example.ORG/es/1?x=/en/": ("m.example.org", "/es/1", "example.org/es/"), "x://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1"),
             "x://example.org/en/2": ("example.org", "/en/2", "org/"), "x://notexample.org/es/": ("notexample.org", "/es/", "org/"),
             "u://a.com/fr/": ("a.com", "/fr/", "com/fr/"), "u://a.com/fr": ("a.com", "/fr", None), "u://a.com/de/x://b": ("a.com", "/de/x:", "com/de/"),
             "u://?q": ("", "", None), "a\n://b.org/\nc": ("b.org", "/\nc", "org/"), "u://org/x": ("org", "/x", "org/")}
    cases["u://a.com/de/x://b"] = ("a.com", "/de/x://b", "com/de/")
    df = llm.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id int, url string, host string")
    none = llm.createDataFrame([], "rule_id string, tokens array<string>, confidence double, support double, key string")
    got = {r.url: r for r in url_rules.judge(df, none, URL_RULES).collect()}
    verdicts = {r.rule: r.verdict for r in URL_RULES}
    for url, (host, path, rule) in cases.items():
        assert (got[url].host, got[url].path, got[url].rule, got[url].verdict) == (host, path, rule, verdicts.get(rule, "allow")), url


def test_mined_rules(llm):
    good = [(f"https://site{i % 7}.example.net/en/{i}", False) for i in range(300)]
    bad = [(f"http://casino.example.net/win/{i}", True) for i in range(60)] + [(f"http://site{i % 7}.example.net/pills/{i}?buy=1", True) for i in range(60)]
    labelled = llm.createDataFrame(good + bad + [(None, True), ("http://x.y/", None)], "url string, blocked boolean")
    mined = url_rules.mine(labelled, 0.01, 0.8)
    rows = mined.collect()
    assert rows and all(r.confidence >= 0.8 for r in rows)
    sets = [set(r.tokens) for r in rows]
    assert not any(a < b for a in sets for b in sets)  # pruned: every rule is as short as can be
    urls = ["http://casino.example.net/win/999", "http://site3.example.net/pills/5?buy=7", "https://site3.example.net/en/5", None] * 2
    got = url_rules.judge(llm.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string"), mined, ()).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == ["block", "block", "allow", "allow"] * 2
    assert url_rules.mine(labelled.limit(0), 0.01, 0.8).count() == 0


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > 3 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        level = left / sum(w[x] for x in open_)
        for s in over:
            assert level * w[s] > 3 * sizes[s]
            out[s] = 3 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mix(llm, documents):
    rng = random.Random(11)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 20 % 3000), "en", rng.choice(["a", "a", "a", "b", "c", "Z", "é", None, "tiny"] if i % 5 else ["a"])) for i in range(900)]
    rows += [(5000, "x", "en", "one"), (5001, None, "en", "empty"), (5002, "", "en", "empty"), (None, "a b c", "en", "a"), (5003, "q", "en", "one"), (5003, "q", "en", "one")]
    got = entropy_mix.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source_of = {(r[0], words(r[1])): r[3] for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    want, taken = _targets(sizes), {}
    for r in got:
        s = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        if sizes[s] > 1000:
            assert abs(taken[s] - t) <= 0.01 * t, (s, taken[s], t)
    again = entropy_mix.mix(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    out = entropy_mix.mixed(documents(rows))
    assert out.columns == documents(rows).columns and out.count() == sum(r.copies for r in got)
    assert entropy_mix.mix(documents([])).count() == 0 and entropy_mix.mixed(documents([])).count() == 0


def test_rates_solve_the_dual(llm):
    sizes = llm.createDataFrame([("=a", "a", n, 0.5) for n in (1, 2, 3, 50, 400)] + [("=b", "b", 7, 0.5)], "src string, source string, size long, u double")
    goals = llm.createDataFrame([("=a", "a", 456, 5, 900.0), ("=b", "b", 7, 1, 0.7)], "src string, source string, source_size long, n_docs long, target double")
    solved = entropy_mix.balance(sizes, goals)
    r = entropy_mix.rate(F.col("size"), F.col("lam"), F.col("scale"), 3.0)
    got = {x.src: x.w for x in sizes.join(solved.select("src", "lam", "scale"), "src").groupBy("src").agg(F.sum(r * F.col("size")).alias("w")).collect()}
    assert abs(got["=a"] - 900) < 0.01 and abs(got["=b"] - 0.7) < 0.01


def test_many_sources_keep_their_place(llm):
    frame = llm.createDataFrame([(f"={i:04d}",) for i in random.Random(1).sample(range(5000), 700)], "src string")
    got = [r.src for r in entropy_mix.place(frame, "src").orderBy("place").collect()]
    assert got == sorted(got) and [r.place for r in entropy_mix.place(frame, "src").orderBy("place").collect()] == list(range(700))
