"""WARC bundles, vector and code searches and chat formatting against plain Python."""

import hashlib
import io
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import _vectors, additive_ann, binary_topk, chat, warc
from gridloom.llm._base import scratch, slices

SF = "/root/testdata/sf0.001"

# -- 7: WARC --------------------------------------------------------------------------------------


def described(rows, least=100):
    """What each (page_id, html) should be told as."""
    by = defaultdict(list)
    for k, h in rows:
        by[h or ""].append(k)
    out = []
    for k, h in rows:
        raw = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        first = min(ids) if ids and len(by[h or ""]) > 1 and len(raw) >= least else None
        again = first is not None and k != first
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def odd_pages(spark):
    page = "<p>é中\r\n\r\n</p>" * 20
    rows = [(5, "http://a/ b", page), (3, None, page), (9, "u", page), (9, "u", page), (None, "x\ny", page), (1, "e", None), (2, "e", ""), (4, "", "short"), (6, "", "short"), (None, "n", "x" * 100), (None, "n", "x" * 100), (7, "n", "y" * 99), (8, "n", "y" * 99), (10, "long", "z" * 3_000_000), (11, "long", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("k", "u", "t", "d", "digest", "first", "again")}).repartition(3)


def test_archives(spark, duck):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted((tuple(r) for r in warc.archived_pages(pages).collect()), key=str)
    assert got == described([(r.page_id, r.html) for r in pages.collect()])
    assert got == sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in duck.sql(warc.ARCHIVED_SQL).to_arrow_table().to_pylist()), key=str)
    odd = odd_pages(spark)
    rows = [(r.page_id, r.html) for r in odd.collect()]
    assert sorted((tuple(r) for r in warc.archived_pages(odd).collect()), key=str) == described(rows)
    index = warc.write_bundles(odd, scratch(spark, "w"), frame_bytes=2000)
    back = warc.read_records(index).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in back if r.record_type == "response" and r.page_id) == sorted((k, (h or "").encode()) for (k, _, _, kind, _), (_, h) in zip(described(rows), sorted(rows, key=str), strict=True) if kind == "response" and k)
    assert {r.url for r in back if r.page_id == 5} == {"http://a/%20b"}
    assert warc.archived_pages(odd.limit(0)).count() == 0


def test_bundles_are_ordinary_zstandard():
    """Frames can be read one by one, and a reader that knows nothing of the table reads the whole."""
    out = io.BytesIO()
    to = warc.BundleWriter(out, 50)
    raw = [warc.record(i, "u", bytes([65 + i]) * 30, "d", None, False) for i in range(5)]
    places = [to.add(r) for r in raw]
    to.close()
    table = warc.seek_table(out, len(out.getvalue()))
    assert len(table) == 5 and [p[0] for p in places] == list(range(5))
    for (at, c, d), r in zip(table, raw, strict=True):
        assert zstandard.decompress(out.getvalue()[at : at + c]) == r and len(r) == d
    out.seek(0)
    assert zstandard.ZstdDecompressor().stream_reader(out, read_across_frames=True).read() == b"".join(raw)
    headers, block = warc.parse(raw[2])
    assert block == b"C" * 30 and headers["warc-type"] == "response"
    for bad in (raw[0][:-1], b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc.seek_table(io.BytesIO(b"x" * 40), 40)


# -- 4 and 8: searches ----------------------------------------------------------------------------


def odd_vectors(spark, n=700, d=8):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, d))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * r.normal(size=d)]) for i in range(n)]
    same = rows[1][1]
    rows += [(1000 + i, same) for i in range(60)]
    rows += [(1100, None), (1200, [0.0] * d), (1300, [float("nan")] * d), (1400, [float("inf")] + [1.0] * (d - 1)), (1500, [None] + [1.0] * (d - 1)), (1600, [1.0]), (None, same), (200, rows[200][1]), (5, rows[5][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "score", "rank", "query_id")}).repartition(4), rows


def usable(rows, d=8):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == d and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]


def brute(rows, measure, k=10):
    out = {}
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        v = min((tuple(x) for i, x in rows if i == q))
        out[q] = sorted((measure(np.array(v), x), i) for i, x in rows if i != q)[:k]
    return out


def test_nearest_vectors(spark):
    df, rows = odd_vectors(spark)
    want = brute(usable(rows), lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    got = defaultdict(list)
    for r in additive_ann.nearest_vectors(df, dims=8, rerank=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id, r["rank"]))
    assert set(got) == set(want)
    hits = 0
    exact = dict(usable(rows))
    for q, found in got.items():
        assert [x[2] for x in found] == list(range(1, 11)) and found == sorted(found)
        assert all(s == float(np.sqrt(((exact[q] - exact[i]) ** 2).sum())) and i != q for s, i, _ in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.95 * 10 * len(want)
    assert [x[1] for x in got[1000]] == [i for _, i in want[1000]]
    few = df.filter("vec_id in (0, 1, 2)")
    assert additive_ann.nearest_vectors(few, dims=8).count() == 2 and additive_ann.nearest_vectors(df.limit(0), dims=8).count() == 0


def test_invalid_rows_of_a_repeated_query_id(spark):
    """Rows that take no part don't hide a valid vector of the same id, whether they sort first or last."""
    bad = [[0.0] * 4, [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [float("-inf"), 1.0, 1.0, 1.0], [-9.0], None]
    rows = [(100 * k, v) for k, v in enumerate(bad)] + [(100 * k, [1.0, 2.0, 3.0, 4.0 + k]) for k in range(len(bad))]
    df = spark.createDataFrame([*rows, (900, [0.0] * 4)], "vec_id long, embedding array<double>")
    for find in (additive_ann.nearest_vectors, binary_topk.nearest_codes):
        got = defaultdict(set)
        for r in find(df, dims=4).collect():
            got[r.query_id].add(r.vec_id)
        ids = {100 * k for k in range(len(bad))}
        assert got == {q: ids - {q} for q in ids}


def test_recall_on_the_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    want = brute(rows, lambda a, b: float(((a - b) ** 2).sum()))
    got = defaultdict(set)
    for r in additive_ann.nearest_vectors(df).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)


def test_nearest_codes(spark, duck):
    df, rows = odd_vectors(spark)
    measure = lambda a, b: int(((a >= 0) != (b >= 0)).sum())
    want = brute(usable(rows), measure)
    got = defaultdict(list)
    for r in binary_topk.nearest_codes(df, dims=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    assert got == want
    assert binary_topk.nearest_codes(df.limit(0), dims=8).count() == 0
    found = sorted(tuple(r) for r in binary_topk.nearest_codes(spark.read.parquet(f"{SF}/embeddings.parquet")).collect())
    assert found == sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in duck.sql(binary_topk.NEAREST_SQL).to_arrow_table().to_pylist())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 12), st.sampled_from([4, 8]), st.booleans())
def test_multi_index_hashing(seed, n, k, segments, near):
    r = np.random.default_rng(seed)
    codes = np.unique(r.integers(0, 2**64, n, dtype=np.uint64) if not near else np.uint64(r.integers(0, 2**63)) ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)))
    queries = np.concatenate([codes[:2], r.integers(0, 2**64, 2, dtype=np.uint64)])
    q, place, distance = binary_topk.Index(codes, segments).nearest(queries, k)
    for i, x in enumerate(queries):
        every = np.bitwise_count(codes ^ x).astype(int)
        edge = np.sort(every)[min(k, len(codes)) - 1]
        found = {int(p): int(d) for p, d, who in zip(place, distance, q, strict=True) if who == i}
        assert {p: int(every[p]) for p in np.flatnonzero(every <= edge)} == found and (q == i).sum() == len(found)


def test_search_does_less_than_a_scan():
    """As the operator searches: 11 nearest of a chunk's random codes; a bound from rows before makes it less."""
    r = np.random.default_rng(0)
    codes = np.unique(r.integers(0, 2**64, _vectors.CHUNK, dtype=np.uint64))
    queries = codes[:100]
    index = binary_topk.Index(codes)
    index.nearest(queries, 11)
    first = index.verified
    assert first < 0.25 * len(codes) * len(queries)
    q, _, d = index.nearest(queries, 11, np.full(100, 14))
    assert index.verified - first < 0.6 * first and d.max() <= 14 and set(q) == set(range(100))
    every = np.bitwise_count(codes[None, :] ^ queries[:, None])
    assert [int((every[i] <= min(14, np.sort(every[i])[10])).sum()) for i in range(100)] == list(np.bincount(q))


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_over_several_chunks(spark, kind):
    """50,000 vectors in two chunks of a task, 1.5 % of them reranked."""
    r = np.random.default_rng(2)
    rows = r.normal(size=(50_000, 64)) if kind == "even" else r.normal(size=(500, 64))[r.integers(0, 500, 50_000)] + 0.3 * r.normal(size=(50_000, 64))
    rows = rows.astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), 64).cast(pa.list_(pa.float32()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": lists})).coalesce(1)
    asked = df.filter("vec_id % 500 = 0")
    got = defaultdict(set)
    for x in additive_ann.nearest_vectors(df, asked).collect():
        got[x.query_id].add(x.vec_id)
    hits = 0
    for i in range(0, 50_000, 500):
        far = ((rows - rows[i]).astype(float) ** 2).sum(1)
        far[i] = np.inf
        hits += len(got[i] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * 100


def test_few_rows_leave_the_tasks(spark, monkeypatch):
    """However many chunks a task has, it gives out k rows a query at most, and they're the best."""
    monkeypatch.setattr(_vectors, "CHUNK", 40)
    _, rows = odd_vectors(spark)
    good, best = usable(rows), _vectors.Best(3, 4)
    r = np.random.default_rng(1)
    q, i, s = r.integers(0, 3, 500), r.permutation(500), r.integers(0, 30, 500)
    for a in range(0, 500, 60):
        some = s[a : a + 60] <= best.bound[q[a : a + 60]]
        best.add(*(x[a : a + 60][some] for x in (q, i, s)))
        assert len(best.query) <= 12
    want = [(k, i_, s_) for k in range(3) for s_, i_ in sorted(zip(s[q == k], i[q == k], strict=True))[:4]]
    assert list(zip(best.query, best.ids, best.score, strict=True)) == want and len(good) > 700


def test_additive_codes():
    r = np.random.default_rng(0)
    rows = r.normal(size=(3000, 16)).astype(np.float32)
    books = additive_ann.train(rows, 4, 64)
    codes = additive_ann.encode(rows, books)
    error = ((rows - additive_ann.decode(codes, books)) ** 2).sum(1).mean()
    greedy = ((rows - additive_ann.decode(additive_ann.encode(rows, books, beam=1), books)) ** 2).sum(1).mean()
    assert error < greedy < (rows**2).sum(1).mean() * 0.5


def test_chunks_of_vectors():
    batch = pa.RecordBatch.from_pydict({"id": pa.array([5, 4, None, 3, 2], pa.int64()), "v": pa.array([[1.0], [2.0], [1.0], None, [3.0]])})
    out = list(_vectors.chunks(iter([batch, batch]), 1, 2))
    assert [(list(i), v.ravel().tolist()) for i, v in out] == [([4, 5], [2.0, 1.0]), ([2], [3.0]), ([4, 5], [2.0, 1.0]), ([2], [3.0])]


# -- 10: chat -------------------------------------------------------------------------------------


def told(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    form = "<s>" + "".join(f"[TURN {chat.escape(r or '')}]\n{chat.escape(t or '')}</s>\n" for r, t in turns)
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(form)


def check_chat(df):
    by = defaultdict(list)
    low = lambda x: (x is not None, x or "")
    for r in sorted(df.collect(), key=lambda r: ((r.turn is not None, r.turn or 0), low(r.role), low(r.text))):
        by[r.conv_id].append((r.role, r.text))
    by[-1] += [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: tuple(r)[1:] for r in chat.formatted_conversations(df).collect()}
    assert got == {k: told(v) for k, v in by.items()}
    return got


def test_conversations(spark, duck):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert check_chat(df) == {r["conv_id"]: tuple(r[n] for n in names) for r in duck.sql(chat.FORMATTED_SQL).to_arrow_table().to_pylist()}
    odd = [(1, 0, "user", None), (1, 1, "assistant", "é中<[]\\>]\n"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "system", "x"), (None, None, None, None), (2, 5, "tool]\n</s>", "</s>\n[TURN x]\n"), (2, None, "assistant", ""), (3, 1, "assistant", "<" * 50_000), (0, 0, "user", "q")]
    odd += [(7, i, random.Random(i).choice(["user", "assistant"]), "t" * (i % 9)) for i in range(30)]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("c", "part", "n_turns")}).repartition(3)
    check_chat(df)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    def turns(n, conv):
        return pa.RecordBatch.from_pydict({"c": pa.array([conv] * n, pa.int64()), "role": ["assistant", "user"] * (n // 2), "text": [f"{i}<" for i in range(n)]})

    monkeypatch.setattr(chat, "_HELD_TURNS", 5)
    for batches in ([turns(4, 1), turns(4, 1), turns(2, 1), turns(4, 2)], [turns(8, 1), turns(2, None), turns(8, None), turns(2, 3)], [turns(10, 0), turns(10, None)]):
        want, got = defaultdict(str), defaultdict(str)
        for b in batches:
            for c, r, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                want[c] = (want[c] or "<s>") + f"[TURN {r}]\n{chat.escape(t)}</s>\n"
        parts = defaultdict(list)
        for out in chat._format(iter(batches)):
            for r in out.to_pylist():
                got[r["conv_id"]] += r["text"]
                parts[r["conv_id"]].append(r["part"])
                assert [chat.unescape(r["text"][a : a + n]) for a, n in zip(r["loss_start"], r["loss_chars"], strict=True)] == [t for x, t in chat.parse(r["text"]) if x == "assistant"]
        assert got == want and all(p == list(range(len(p))) for p in parts.values())


def test_one_conversation_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(chat, "_HELD_TURNS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for hot in (5, None):
        rows = [(hot, i, ("user", "assistant")[i % 2], f"<{i}] é") for i in range(2000)] + [(c, i, "assistant", f"{c} {i}") for c in (1, 2, 9) for i in range(3)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
        out = chat.format_chat(df).collect()
        parts = sorted((r for r in out if r.conv_id == hot), key=lambda r: r.part)
        assert len({r.part >> 33 for r in parts}) > 1 and [r.opens for r in parts] == [True] + [False] * (len(parts) - 1)
        assert "".join(r.text for r in parts) == "<s>" + "".join(f"[TURN {r}]\n{chat.escape(t)}</s>\n" for _, _, r, t in rows[:2000])
        assert [r.text[a : a + n] for r in parts for a, n in zip(r.loss_start, r.loss_chars, strict=True)] == [chat.escape(x[3]) for x in rows[1:2000:2]]
        check_chat(df)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.text("ab<[]/\\sé中\n", max_size=8), st.text("ab<[]/\\s>é中\n", max_size=12)), max_size=8))
def test_assembly(turns):
    turns.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    rows = pa.table({"c": pa.array([t[0] for t in turns], pa.int64()), "role": pa.array([t[1] for t in turns], pa.string()), "text": pa.array([t[2] for t in turns], pa.string())})
    if not turns:
        return
    by = defaultdict(list)
    for c, r, t in turns:
        by[c].append((r, t))
    out = chat.assemble(rows).to_pylist()
    assert {r["conv_id"]: chat.parse(r["text"]) for r in out} == by
    assert all(len(r["text"]) == told(by[r["conv_id"]])[4] and "</s>" not in r["text"].replace("</s>\n[TURN ", "").removesuffix("</s>\n") for r in out)


def test_slices():
    batch = pa.RecordBatch.from_pydict({"t": ["aa", None, "b" * 50, "", "cc"], "i": [1, 2, 3, 4, 5]})
    parts = list(slices(batch.slice(1), "t", 10))
    assert [p.column("i").to_pylist() for p in parts] == [[2], [3], [4, 5]]
