"""Vector codes, SimHash links and fill-in-middle against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.oracle_check import compare, duck
from wayfold.llm import fill_in_middle, simhash_dedup, vector_codes
from wayfold.llm.common import attach
from wayfold.llm.oracle import llm_sql
from wayfold.llm.queries import llm_queries

SF = "/root/testdata/sf0.001"
EDGE = [None, "", "   \n\t ", "one", "one", "A b c d e f", "x" * 300_000, "é" * 50 + " " + "ß🙂 " * 40, "a<P>b c d", "<S", "S> <", "漢字" * 30]


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ----------------------------------------------------------------- fill in the middle


def _fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if form == "spm" else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return n, form, a, b - a, out


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(3)
    texts = EDGE + ["".join(rng.choice("ab <PSM>é漢🙂\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(k if k != 40 else None, t, "x", "y", 1) for k, t in enumerate(texts)] + [(3, "one", "x", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, form string, n int")
    got = fill_in_middle.transform(docs)
    want = sorted(((d, *_fim(d, t)) for d, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert got.where(~fill_in_middle.restored().eqNullSafe(got.output) & (got.form == "plain")).count() == 0
    hashes = {r.doc_id: r for r in fill_in_middle.digests(got).collect()}
    for d, t, *_ in rows:
        assert hashes[d].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert hashes[d].output_sha256 == hashlib.sha256(_fim(d, t)[4].encode()).hexdigest()
    assert fill_in_middle.transform(docs.limit(0)).count() == 0
    ids = spark.createDataFrame([("a", "some text here")], "doc_id string, text string")
    assert fill_in_middle.transform(ids).first().doc_id == "a"


def test_exception_index_is_sparse_and_exact():
    texts = ["plain ascii", "", "é漢🙂a", "zz🙂", "b" * 1000 + "ß"]
    body = "".join(texts).encode()
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    index = fill_in_middle.ExceptionIndex(np.frombuffer(body, np.uint8), offsets)
    assert len(index.point) == 5  # only the characters of more than one byte
    assert np.diff(index.offsets).tolist() == [len(t) for t in texts]
    whole = "".join(texts)
    cuts = np.arange(len(whole) + 1)
    assert index.to_bytes(cuts).tolist() == [len(whole[:k].encode()) for k in cuts]
    assert index.to_points(index.to_bytes(cuts)).tolist() == cuts.tolist()


# ----------------------------------------------------------------- SimHash


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius):
    """Least index that each can reach, over all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    texts = list(EDGE)
    for base in bases:
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append("\n ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    docs = spark.createDataFrame([(k, t, "f", "c") for k, t in enumerate(texts)], "doc_id bigint, text string, fp string, component string")
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    prints = [_fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(texts))] == _components(prints, 3)
    assert len({got[k].component_id for k in range(len(texts))}) < len(set(prints))  # some links are between different prints
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_reach_the_whole_ball_and_no_further(spark, radius):
    rng = random.Random(radius)
    prints = [0, (1 << 64) - 1]
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.append(p)
        for _ in range(4):  # partners at one to six bits, spread over the word or side by side
            n = rng.randint(1, 6)
            bits = rng.sample(range(64), n) if rng.random() < 0.6 else [(rng.randrange(64) + k) % 64 for k in range(n)]
            prints.append(p ^ sum(1 << b for b in set(bits)))
    prints = sorted(set(prints), key=_signed)
    heads = spark.createDataFrame([(_signed(p),) for p in prints], "fp bigint")
    close = simhash_dedup.sifted(heads, radius) if radius else heads.limit(0)
    edges = simhash_dedup.links(close, radius).collect()
    place = {_signed(p): k for k, p in enumerate(prints)}
    assert all((prints[place[e.u]] ^ prints[place[e.v]]).bit_count() <= radius for e in edges)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(place[e.u]), find(place[e.v])
        parent[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(prints))] == _components(prints, radius)


def test_simhash_with_text_and_null_ids(spark):
    docs = spark.createDataFrame([("b", "same words here now"), ("a", "Same words  here now"), (None, "same words here now"), (None, "alone in the world"), ("b", "same words here now"), ("z", None)], "doc_id string, text string")
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash_dedup.near_duplicates(docs).collect()), key=repr)
    assert [(d, c) for d, c, _ in got if f"{_fingerprint('same words here now'):016x}" == _] == [("a", "a"), ("b", "a"), ("b", "a"), (None, "a")]
    assert [(d, c) for d, c, f in got if f == "0" * 16] == [("z", "z")]
    assert (None, None, f"{_fingerprint('alone in the world'):016x}") in got


def test_attach_keeps_rows_of_hot_and_null_keys(spark):
    rows = spark.range(3000).selectExpr("id", "case when id < 1500 then 'hot' when id < 1600 then null else concat('k', id) end as key")
    values = rows.where("key is not null").groupBy("key").count().selectExpr("key", "count as n", "concat('v', key) as v")
    out = attach(rows, "key", values, "v")
    assert out.columns == ["id", "key", "v"]
    assert out.count() == 3000 and out.where("not v <=> concat('v', key)").count() == 0


# ----------------------------------------------------------------- vector codes


def _codes(rows):
    """Lloyd's rounds with every distance in full; rows: (vec_id, list of components, label)."""
    fine = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    x = np.array([np.floor(np.float32(v).astype(float) * 1024) for _, v, _ in fine]).astype(np.int64).reshape(len(fine), 4, -1)
    start = sorted(range(len(fine)), key=lambda k: fine[k][0])[:256]
    books = [x[start, p].copy() for p in range(4)]

    def nearest(p):
        d = ((x[:, p][:, None] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(4):
        for p in range(4):
            e, _d = nearest(p)
            for k in set(e.tolist()):
                own = x[e == k, p]
                books[p][k] = np.floor_divide(own.sum(0), len(own))
    both = [nearest(p) for p in range(4)]
    code = ["".join(f"{both[p][0][k]:02x}" for p in range(4)) for k in range(len(fine))]
    error = sum(b[1] for b in both)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    total = {}
    for (_, _, lab), e in zip(fine, error, strict=True):
        total[lab] = total.get(lab, 0) + int(e)
    return {f[0]: (code[k], int(error[k]), total[f[2]], sha) for k, f in enumerate(fine)}


VECTORS = "vec_id bigint, embedding array<float>, label int, ints string, n int"


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(700):
        v = [float(f) for f in rng.normal(0, 0.3, 8).astype(np.float32)]
        rows.append((1000 - k, v if k % 50 else [0.25] * 8, [None, 1, 2][k % 3]))
    rows += [(5000, None, 1), (5001, [1.0] * 7 + [None], 1), (5002, [float("nan")] * 8, 2), (5003, [float("-inf")] * 8, 2), (-7, [float("inf")] * 8, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = {r.vec_id: tuple(r)[1:] for r in vector_codes.compressed(frame).collect()}
    assert got == _codes(rows)


def test_codes_of_small_and_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compressed(empty).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "x", 1), (2, [1.0, 2.0, 3.0, 4.0, 5.0], None, "x", 1), (2, [1.0] * 3, 1, "x", 1), (None, [9.0] * 5, 1, "x", 1), (3, [3e38] * 5, 1, "x", 1), (4, [], 1, "x", 1)], VECTORS)
    got = sorted((tuple(r)[:3] for r in vector_codes.compressed(few).collect()), key=repr)
    assert [g[0] for g in got] == [1, 2, 3, None]  # other lengths than that of the first id are dropped
    rows = vector_codes.integers(few)
    model = vector_codes.fit(rows)
    assert model.length == 5 and model.entries.shape == (4, 3, 2)
    coded = vector_codes.encode(rows, model)
    back = vector_codes.decode(coded, model)
    assert [round(x, 2) for x in back.where("vec_id = 1").first().vector] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_slices_are_exact_for_any_codebook():
    rng = np.random.default_rng(4)
    for entries, width, spread in [(1, 3, 10), (2, 1, 3), (64, 16, 50), (65, 4, 2), (256, 16, 500), (200, 0, 1)]:
        book = rng.integers(-spread, spread + 1, (entries, width))
        q = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (300, width)), book[:50]])
        e, d = vector_codes.Slices(book).nearest(q)
        full = ((q[:, None] - book[None]) ** 2).sum(2)
        assert (d == full.min(1)).all() and (e == full.argmin(1)).all()


@pytest.mark.parametrize("key", ["op11_vector_codes", "op13_fill_in_middle"])
def test_query_matches_sql(spark, key):
    out = compare(spark, SF, key, llm_queries()[key], llm_sql()[key], duck(SF))
    assert out["match"], out


def test_query_op12_whole_table(spark):
    got = llm_queries()["op12_simhash_dedup"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: _fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    least = _components([prints[d] for d in ids], 3)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", ids[least[k]]) for k, d in enumerate(ids)}
