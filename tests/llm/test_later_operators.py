"""Operators 11 to 13 on edge rows, empty tables and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abode.llm import (imatch, mixing, ngram_join, piece_sampling, quality_model, quality_rules, registry, secret_scan, token_counts,
                       turn_repair, url_filter, vector_codes)
from abode.llm.arrowtext import utf8
from tests.conftest import SF0001
from tests.llm.helpers import edge_docs

registry.load_all()


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_turn_repair", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    rel = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in rel.description]
    df = registry.QUERIES[name](spark, SF0001)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, ([v for _, v in sorted(zip(columns, r))] for r in rel.fetchall())))
    assert sorted(map(repr, ([v for _, v in sorted(zip(df.columns, r))] for r in df.collect()))) == want


# 11 ------------------------------------------------------------------------------------------

URLS = [
    (None, "", "", None), ("no scheme.org/x", "", "", None), ("http://", "", "", None), ("://com/fr/", "com", "/fr/", "com/fr/"),
    ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/"), ("http://example.org/en/1x?q=/es/", "example.org", "/en/1x", "example.org/en/1"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"), ("http://example.org", "example.org", "", None),
    ("http://x.com/de/#top", "x.com", "/de/", "com/de/"), ("http://x.comm/de/", "x.comm", "/de/", None), ("http://É.com/fr/", "É.com", "/fr/", "com/fr/"),
    ("http://x.com?a=://org/", "x.com", "", None), ("see http://x.org/a://b.com/fr/", "x.org", "/a://b.com/fr/", "org/"),
]


def pages(spark, rows, extra=""):
    names = "page_id long, url string" + (f", {extra} string" if extra else "")
    return spark.createDataFrame([(i, u, *(["kept"] if extra else [])) for i, u in enumerate(rows)], names)


@pytest.mark.parametrize("extra", ["", "Host", "VERDICT", "_ruled", "_key", "_row", "n"])
def test_hosts_paths_and_longest_rules(spark, extra):
    out = url_filter.filter_urls(pages(spark, [u[0] for u in URLS], extra))
    assert [c.lower() for c in out.columns].count("host") == 1 and [c.lower() for c in out.columns].count("verdict") == 1
    got = {r.page_id: r for r in out.collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == [u[1:] for u in URLS]
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got.values() if r.rule)
    assert {r.verdict for r in got.values()} <= {"allow", "block"}


def test_empty_pages(spark):
    assert url_filter.filter_urls(pages(spark, ["http://x.com/"]).limit(0)).collect() == []


def posterior(outcomes):
    """host -> lower bound of the blocked share, in plain loops; outcomes are (host, n, k)."""
    def suffix(h):
        m = re.search(rf"(?:^|\.)((?:{'|'.join(url_filter.SECOND_LEVEL)})\.[a-z]{{2}})$", h)
        return h if re.match(r"^[0-9.]+$|^\[", h) else m[1] if m else h.split(".")[-1]

    def domain(h):
        s = suffix(h)
        return h if h == s else h[:len(h) - len(s) - 1].split(".")[-1] + "." + s

    def strength(children):
        pairs = sum(n * (n - 1) for n, _, _ in children)
        if not pairs:
            return url_filter.FLAT
        scatter = sum((k - n * m) ** 2 / (m * (1 - m)) for n, k, m in children) - sum(n for n, _, _ in children)
        low, high = url_filter.STRENGTHS
        return 1 / min(max(round(scatter / pairs, 9), 1 / (1 + high)), 1 / (1 + low)) - 1

    def add(key):
        out = {}
        for h, n, k in outcomes:
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + k)
        return out

    total = [sum(o[i] for o in outcomes) for i in (1, 2)]
    mean = {"": (total[1] + 1) / (total[0] + 2)}
    parents = [lambda h: "", suffix, domain, lambda h: h]
    for parent, key in zip(parents, parents[1:]):
        counts = add(key)
        up = {key(h): mean[parent(h)] for h, _, _ in outcomes}
        s = strength([(n, k, up[c]) for c, (n, k) in counts.items()])
        mean = {c: (s * up[c] + k) / (s + n) for c, (n, k) in counts.items()}
    return {h: mean[h] - 2 * math.sqrt(mean[h] * (1 - mean[h]) / (s + n + 1)) for h, (n, _) in add(lambda h: h).items()}


OUTCOMES = [("a.bad.com", 40, 39), ("b.bad.com", 30, 30), ("c.bad.com", 0, 0), ("a.good.com", 50, 2), ("b.good.com", 9, 0), ("new.com", 0, 0),
            ("x.co.uk", 5, 5), ("y.x.co.uk", 0, 0), ("co.uk", 1, 0), ("10.0.0.1", 3, 1), ("", 0, 0), ("lone", 1, 1)]


@pytest.mark.parametrize("bound", [url_filter.BROADCAST_ROWS, 0])
def test_reputations_against_loops(spark, bound):
    rows = spark.createDataFrame(OUTCOMES, "host string, n long, k long")
    got = {r.host: r for r in url_filter.reputations(rows, bound).collect()}
    want = posterior(OUTCOMES)
    assert got.keys() == want.keys() and all(abs(got[h].block_bound - want[h]) < 1e-8 for h in want)
    assert got["y.x.co.uk"].domain == "x.co.uk" and got["10.0.0.1"].suffix == "10.0.0.1" and got["c.bad.com"].domain == "bad.com"
    assert got["a.bad.com"].block_bound > 0.5 > got["a.good.com"].block_share


@pytest.mark.parametrize("bound", [url_filter.BROADCAST_ROWS, 0])
def test_hosts_without_a_rule_follow_their_reputation(spark, bound):
    urls = [f"http://{'w' * (i % 3)}.spam.com/de/{i}" for i in range(300)] + [f"http://ok{i % 5}.fine.com/fr/{i}" for i in range(300)]
    urls += ["http://w.spam.com/en/1", "http://ww.spam.com/x", "http://ok1.fine.com/en/2", "http://other.net/"]
    got = {r.url: r.verdict for r in url_filter.filter_urls(pages(spark, urls), bound=bound).collect()}
    assert [got[u] for u in urls[-4:]] == ["block", "block", "allow", "allow"]
    assert len(got) == len(urls)


def test_url_filter_stays_in_the_jvm(spark):
    plan = url_filter.filter_urls(pages(spark, ["http://x.com/"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# 12 ------------------------------------------------------------------------------------------

PREFIX = re.compile(r"s?(ua)*u?")
WHOLE = re.compile(r"(s?(ua)+)?")


def least_repair(kinds):
    """(cost, audit) by keeping every output string with its least repair."""
    best = {"": (0, "")}

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for text, (cost, audit) in list(out.items()):
                for t in "ua":
                    if PREFIX.fullmatch(text + t):
                        out[text + t] = min(out.get(text + t, (1 << 30, "")), (cost + 3, audit + "I"))
        return out

    for symbol, must_go, cut in kinds:
        nxt = {}
        for text, (cost, audit) in best.items():
            nxt[text] = min(nxt.get(text, (1 << 30, "")), (cost + 4, audit + "D"))
        if not must_go:
            for text, (cost, audit) in inserted(best).items():
                for t, edit, price in [(symbol, "K", 0), ("u", "R", 3), ("a", "R", 3)]:
                    if PREFIX.fullmatch(text + t):
                        nxt[text + t] = min(nxt.get(text + t, (1 << 30, "")), (cost + price + 3 * cut, audit + edit))
        best = nxt
    return min(v for text, v in inserted(best).items() if WHOLE.fullmatch(text))


KIND = st.tuples(st.sampled_from("suaxS "), st.booleans(), st.booleans()).map(lambda k: (k[0], k[1], k[2] and not k[1]))
PARSER = turn_repair.Parser()


@settings(max_examples=400, deadline=None)
@given(st.lists(KIND, max_size=7))
def test_least_repairs_against_all_outputs(kinds):
    assert PARSER.repair(kinds) == least_repair(kinds)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([("s", False, False), ("u", False, False), ("a", False, False), ("u", False, True), ("a", True, False)]), min_size=8, max_size=11))
def test_longer_repairs(kinds):
    assert PARSER.repair(kinds) == least_repair(kinds)


def test_known_repairs():
    k = lambda roles: [(r, False, False) for r in roles]
    assert PARSER.repair([]) == (0, "") and PARSER.repair(k("suaua")) == (0, "KKKKK")
    assert PARSER.repair(k("s")) == (4, "D") and PARSER.repair(k("u")) == (3, "KI") and PARSER.repair(k("a")) == (3, "IK")
    assert PARSER.repair(k("uu")) == (3, "KR") and PARSER.repair([("u", True, False)]) == (4, "D")
    assert PARSER.repair(k("ua" * 20000)) == (0, "K" * 40000)
    assert len(PARSER.nodes) < 40 and len(PARSER.steps) < 5000  # finitely many stacks and frontiers


CHATS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"),
    (2, 0, "user", "a."), (2, 0, "user", "a."), (2, 5, "assistant", "cut"), (2, None, "user", "first"),
    (3, 0, "tool", "x."), (3, 1, None, None), (4, None, None, None), (None, 1, "user", "q?"), (None, 2, "assistant", " \t"),
    (5, 1, "assistant", "only."), (6, 3, "user", "é…"), (6, 3, "assistant", "z" * 30000 + "?\n"), (7, 0, "", "no role."),
]


def repaired(spark, rows, extra=""):
    names = "conv_id long, turn long, role string, text string" + (f", {extra} string" if extra else "")
    df = spark.createDataFrame([(*r, *(["kept"] if extra else [])) for r in rows], names)
    plans = turn_repair.plan_repairs(df)
    return {r.conv_id: r for r in plans.collect()}, turn_repair.repaired_turns(df, plans)


@pytest.mark.parametrize("extra", ["", "AUDIT", "Digest", "symbol", "fault", "step"])
def test_faults_and_repaired_turns(spark, extra):
    plans, turns = repaired(spark, CHATS, extra)
    assert set(plans) == {1, 2, 3, 4, 5, 6, 7, None}
    assert plans[1][1:] == (0, 0, 0, 0, 0, 0, "KKK")
    assert plans[2][1:] == (4, 0, 1, 2, 2, 11, "DKDK")  # first., a., a., cut
    assert plans[4][1:] == (0, 1, 0, 0, 0, 4, "D") and plans[None].blank == 1 and plans[None].cost == 7
    assert plans[5].audit == "IK" and plans[7].audit == "D" and plans[7].cost == 4
    said = {}
    for r in turns.collect():
        said.setdefault(r.conv_id, []).append((r.position, r.action, r.role, r.text))
    assert said[1] == [(0, "K", "system", "Be brief."), (1, "K", "user", "Hello."), (2, "K", "assistant", "Hi!")]
    assert said[5] == [(0, "I", "user", ""), (1, "K", "assistant", "only.")] and 4 not in said
    for turns_of in said.values():
        assert WHOLE.fullmatch("".join(t[2][0] for t in sorted(turns_of)))
    digest = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(turns).collect()}
    assert digest[5] == hashlib.sha256(b"user:\nassistant:only.").hexdigest() and set(digest) == set(said)


def test_turn_repair_empty_table(spark):
    plans, turns = repaired(spark, [])
    assert plans == {} and turns.collect() == [] and turn_repair.digests(turns).collect() == []


def test_damage_follows_the_key(spark):
    import zlib
    rows = [(c, t, "assistant", "Yes. No!") for c in (1, None, -7) for t in (*range(60), None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in turn_repair.damaged(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "Yes No")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((c, t), []) == want


# 13 ------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 6), st.sampled_from([1, 3, 50, 100000, vector_codes.BOUND]), st.integers(0, 10**6))
def test_nearest_entries_against_all_distances(k, d, spread, seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (k, d))
    x = np.concatenate([rng.integers(-spread, spread + 1, (200, d)), entries, entries + 1, np.full((2, d), vector_codes.BOUND), np.zeros((1, d), int)])
    index, best = vector_codes.PartIndex(entries).nearest(x)
    all_distances = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == all_distances.argmin(1)).all() and (best == all_distances.min(1)).all()


def brute_codes(rows):
    """vec order -> (code, error), and final codebooks, from all distances; rows are (id, vector)."""
    x = np.array([[math.floor(256 * v) for v in vec] for _, vec in rows], dtype=object)
    n, width = x.shape
    d = width // 16
    order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[list(x[i, p * d:(p + 1) * d]) for i in order[:64]] for p in range(16)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[i, p * d:(p + 1) * d], e)), k) for k, e in enumerate(books[p])) for p in range(16)] for i in range(n)]

    for _ in range(2):
        near = assigned()
        books = [[[sum(c) // len(c) for c in zip(*own)] if (own := [x[i, p * d:(p + 1) * d] for i in range(n) if near[i][p][1] == k]) else e
                  for k, e in enumerate(books[p])] for p in range(16)]
    near = assigned()
    return [(bytes(a[1] for a in row), sum(a[0] for a in row)) for row in near], books


def vector_rows(n, width, seed, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.5, (5, width))
    return [(i if ids is None else ids[i], [float(np.float32(v)) for v in centres[i % 5] + rng.normal(0, 0.1, width)]) for i in range(n)]


@pytest.mark.parametrize("bound", [vector_codes.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("n,width", [(150, 32), (9, 16)])
def test_codes_against_all_distances(spark, n, width, bound):
    rows = vector_rows(n, width, n)
    labels = [None if i % 4 == 3 else i % 4 for i in range(n)]
    df = spark.createDataFrame([(i, v, l, "kept") for (i, v), l in zip(rows, labels)], "vec_id long, embedding array<float>, label int, `Code` string")
    out, books = vector_codes.encode(df.repartition(5), bound=bound)
    got = {r.vec_id: r for r in out.collect()}
    want, want_books = brute_codes(rows)
    assert [(bytes(got[i].code), got[i].error) for i in range(n)] == want and books.tolist() == want_books
    for label in set(labels):
        total = sum(e for (_, e), l in zip(want, labels) if l == label)
        assert all(got[i].label_error == total for i in range(n) if labels[i] == label)
    assert vector_codes.decode(bytes(got[0].code), books).shape == (width,)


def test_codes_of_edge_rows(spark):
    rows = vector_rows(70, 16, 5)
    bad = [(100, None), (101, []), (102, [1.0] * 15 + [None]), (103, [float("nan")] * 16), (104, [float("inf")] + [0.0] * 15),
           (105, [1.0] * 17), (106, [1.0] * 32), (-5, [float("-inf")] * 16), (-9, None)]
    good = [(None, [0.5] * 16), (3, rows[3][1]), (3, [9.0] * 16), (200, [1e30] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + good], "vec_id long, embedding array<double>, label int")
    out, books = vector_codes.encode(df)
    got = out.collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in rows + good) and books.shape == (16, 64, 1)
    assert len({r.code for r in got if r.vec_id == 200}) == 1 and all(r.error >= 0 for r in got)
    assert vector_codes.codebooks_digest(books) == hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()


def test_codes_of_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    for rows in (df, df.limit(0)):
        out, books = vector_codes.encode(rows)
        assert out.collect() == [] and books is None and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.codebooks_digest(None) == hashlib.sha256(b"").hexdigest()


def test_equal_vectors_only(spark):
    df = spark.createDataFrame([(i, [0.25] * 16, None) for i in range(200)], "vec_id long, embedding array<float>, label int")
    out, _ = vector_codes.encode(df)
    assert {(bytes(r.code), r.error, r.label_error) for r in out.collect()} == {(bytes(16), 0, 0)}


# names, all operators ------------------------------------------------------------------------

def _pieces():
    return token_counts.tokenizer_path("piece_bpe_32k.model")


BY_OPERATOR = {
    "quality_model": lambda d: quality_model.score(d, d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label"))),
    "mixing": lambda d: mixing.emit(mixing.mix(d.withColumn("words", mixing.word_count(F.col("text"))), size="words")),
    "mixing_to": lambda d: mixing.emit_to(d, mixing.mix(d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.row_identity(d).alias("_mx_id")), ties=("_mx_id",))),
    "quality_rules": quality_rules.apply_rules,
    "encode": lambda d: piece_sampling.decode(piece_sampling.encode(d, _pieces()), _pieces()),
    "encode_and_check": lambda d: piece_sampling.encode_and_check(d, _pieces()),
    "token_counts": lambda d: token_counts.count_tokens(d, token_counts.tokenizer_path("byte_bpe_50k.json")),
    "secret_scan": lambda d: secret_scan.find_secrets(d, redact=True),
    "ngram_join": lambda d: ngram_join.one_of_each_group(d),
}


@pytest.mark.parametrize("operator", sorted(BY_OPERATOR))
def test_clashing_names_in_any_case(spark, operator):
    names = ["Score", "TARGET", "N_WORDS", "IDS", "N_Tokens", "Secrets", "_qr_words", "_mx_k", "_mx_size", "_sp_key", "_row", "Lossless", "value", "key", "size", "H"]
    docs = edge_docs(spark).where("doc_id in (3, 6, 7, 14) or doc_id is null")
    plain = BY_OPERATOR[operator](docs)
    clashing = docs.select("*", *[F.lit("kept as is").alias(n) for n in names])
    out = BY_OPERATOR[operator](clashing)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    added = [c for c in plain.columns if c not in docs.columns]
    passed = [n for n in names if n.lower() not in {c.lower() for c in added}]
    assert all(r[n] == "kept as is" for r in rows for n in passed if n in out.columns)
    if operator not in ("quality_model", "mixing", "mixing_to", "ngram_join"):  # their results follow whole rows, or are fitted
        assert sorted(map(repr, ([r[c] for c in plain.columns] for r in rows))) == sorted(map(repr, ([r[c] for c in plain.columns] for r in plain.collect())))


# 6 and 10 again ------------------------------------------------------------------------------

def test_fingerprints_against_loops():
    vocabulary = [f"w{i}" for i in range(4000)]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 3, 40, 400, 3000)] + ["", "none of these"]
    word = {w: imatch._terms(*utf8(pa.array([w])))[0][0] for w in vocabulary}
    held = set(vocabulary[:3000])
    lex = np.sort(np.array([word[w] for w in held], np.uint64))
    mix = lambda h, salt: int(imatch.mix64(np.array([h], np.uint64) ^ imatch.mix64(np.array([salt], np.uint64)))[0])
    members = [set() for _ in range(imatch.SUBSETS)]
    for w in held:
        home = mix(word[w], imatch.SUBSETS + 1) % (imatch.SUBSETS // len(imatch.ONE_IN)) * len(imatch.ONE_IN)
        for j, subset in enumerate(members):
            if home == j or mix(word[w], j + 1) % imatch.ONE_IN[j % len(imatch.ONE_IN)] == 0:
                subset.add(w)
    got = imatch.fingerprints(*utf8(pa.array(texts, pa.large_string())), lex)
    for text, f in zip(texts, got):
        groups = [sorted(int(word[w]) for w in set(text.split()) & subset) for subset in members]
        if not any(groups):
            assert f.startswith("=")
            continue
        entries = f.split(".")
        assert [e == "-" for e in entries] == [not g for g in groups]
        by_group = {}
        for e, g in zip(entries, groups):
            assert by_group.setdefault(tuple(g), e) == e
        assert len(set(by_group.values())) > 0.9 * len(by_group)


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = imatch.compare_with_next(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where(F.size(F.split("text", " ")) >= 20)).collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_every_rule_against_its_regex():
    rng = np.random.default_rng(6)
    bits = ["ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "eyJ", "eyJhbGciOi", ".", "-", "_", "AIza", "a" * 36, "B7" * 18, "0" * 20, "1234567890-", "abcDEF123", " ", "\n", "é",
            "eyJhbGci.eyJzdWIi.c2lnbmF0dXJl", "-----BEGIN ", "RSA ", "OPENSSH ", "PRIVATE KEY-----", "AKIA", "Z" * 16, "token=", "secretvalue", '"', "f" * 24]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(4000)]
    found = secret_scan.scanner().scan(*utf8(pa.array(texts, pa.large_string())))
    seen = set()
    for k, text in enumerate(texts):
        for r, rule in enumerate(secret_scan.RULES):
            if rule.kind in secret_scan.BASE_KINDS:
                continue  # compared with the contract's regexes elsewhere
            prefix = {"github": 4, "slack": 5, "google": 4}
            want = [(m.start(), m.end()) for m in re.finditer(rule.regex, text)
                    if (len(m[0].rsplit(".", 1)[1]) if rule.kind == "jwt" else len(m[0]) - prefix.get(rule.kind, 0)) >= rule.least]
            assert [(i, j) for i, j, x in found.get(k, []) if x == r] == want, (rule.kind, text)
            seen |= {rule.kind} if want else set()
    assert seen == {r.kind for r in secret_scan.RULES} - set(secret_scan.BASE_KINDS)


def test_long_walks_without_a_match_are_not_repeated():
    import time
    times = []
    for n in (20_000, 80_000):
        began = time.time()
        assert not secret_scan.scanner().scan(*utf8(pa.array(["a" * 20 + " " + "eyJ" * n])))
        times.append(time.time() - began)
    assert times[1] < 12 * times[0] + 1
