"""Operators 4, 6, 8 and 10: exact round trips and brute force."""

import collections
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import packing as P
from moraine.llm import warc as W
from moraine.llm.chat import CONTROL, ESCAPE, digests, escape, format_windows, op6_budgeted_chat, unescape
from moraine.llm.topk import Blocks, by_content, topk


def test_monolithic_stream_is_normalised():
    raw = [W.record(i, f"http://x/{i}\r\nInjected: 1", bytes([65 + i % 26]) * (i * 400)) for i in range(60)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = z.compress(b"".join(raw)) + z.flush()
    out = io.BytesIO()
    index = W.normalise_stream(io.BytesIO(whole), out)
    assert len(index) == 60 and sum(e["length"] for e in index) == len(out.getvalue())
    for e, r in zip(index, raw, strict=True):
        head, block = W.read_member(out.getvalue(), e["offset"], e["length"])
        assert r.endswith(block + b"\r\n\r\n") and head["warc-record-id"] == e["record_id"] and "injected" not in head
    again = io.BytesIO()
    assert W.normalise_stream(io.BytesIO(out.getvalue()), again) == index and again.getvalue() == out.getvalue()
    with pytest.raises((ValueError, zlib.error)):
        W.normalise_stream(io.BytesIO(W.gzip_member(raw[5][:-9])), io.BytesIO())


def test_archives(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>%d</p>" % (i % 7)) for i in range(50)]
    rows += [(60, None, None), (61, "", ""), (62, "u\n", "é" * 100_000), (None, "n", "only"), (None, "n", "<p>1</p>"), (70, "r", "same"), (70, "r", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rep", F.lit(1)).withColumn("key", F.lit("k")).repartition(3)
    a = W.write_archives(df, str(tmp_path / "a"), archive_bytes=4000)
    assert a.count() > 3
    got = W.read_records(W.normalise(a, str(tmp_path / "b")), payloads=True).collect()
    assert len(got) == len(rows)
    top = collections.defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None and (top[h or ""] is None or i > top[h or ""]):
            top[h or ""] = i
    left = collections.Counter((i, h or "") for i, _, h in rows)
    told = collections.Counter()
    for r in got:
        text = next(h for (i, h), n in left.items() if i == r["page_id"] and n and W.digest32(h.encode()) == r["payload_digest"])
        left[r["page_id"], text] -= 1
        first = top[text] is None or r["page_id"] == top[text] and r["record_type"] == "response"
        told[text] += first
        assert r["payload_bytes"] == len(text.encode()) and r["record_type"] == ("response" if first else "revisit")
        assert r["refers_to"] == (None if first else top[text]) and r["payload"] == (text.encode() if first else None)
    assert all(n == 1 for t, n in told.items() if top[t] is not None)
    files = W.export_files(W.normalise(a, str(tmp_path / "g")), str(tmp_path / "files")).collect()
    for r in files:
        whole = (tmp_path / "files" / r["name"]).read_bytes()
        index = [json.loads(x) for x in (tmp_path / "files" / (r["name"] + ".idx")).read_text().splitlines()]
        assert len(whole) == r["bytes"] == sum(e["length"] for e in index)
        assert all(W.read_member(whole, e["offset"], e["length"])[0]["warc-record-id"] == e["record_id"] for e in index)
    empty = W.write_archives(df.limit(0), str(tmp_path / "c"))
    assert W.read_records(W.normalise(empty, str(tmp_path / "d"))).count() == 0
    plain = W.write_archives(df.where("page_id < 50"), str(tmp_path / "e"), min_bytes=1000)
    assert W.read_records(W.normalise(plain, str(tmp_path / "f"))).where("record_type = 'revisit'").count() == 0


def brute_chat(rows):
    conv = collections.defaultdict(list)
    for r in rows:
        conv[r[0]].append(r)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, x in conv.items():
        x.sort(key=lambda r: ((r[1] is not None, r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        loss = "".join(r[3] or "" for r in x if r[2] == "assistant")
        out[c] = (len(x), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in x)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("budget,history,turns", [(1024, 256, 2), (120, 40, 3), (64, 0, 0)])
def test_chat(spark, budget, history, turns):
    rng = random.Random(2)
    bits = ["hello ", "<|turn|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", ESCAPE, ESCAPE + "e", "<<SYS>>", "é𝄞", "\n", "<", "|", "<s", ">", "p"]
    rows = []
    for c in range(60):
        if c % 2:
            rows.append((c, 0, "system", "be kind " + rng.choice(bits)))
        rows += [(c, t, ("user", "assistant")[t % 2], "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for t in range(1, rng.randint(2, 25))]
    rows += [(100, 1, None, None), (100, None, "assistant", "x"), (101, 1, "assistant", "y"), (101, 1, "assistant", "y"), (None, 1, "assistant", "z"), (102, 1, "od\nd", "w" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)).repartition(3)
    windows = format_windows(df, budget, history, turns)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digests(windows).collect()}
    assert got == brute_chat(rows)
    for r in windows.collect():
        assert r["n_repeated"] <= turns + 1 and (r["window"] > 0 or r["n_repeated"] == 0)
        assert -(-len(r["formatted"].encode()) // 4) <= budget
        for c in CONTROL:
            if c not in ("<|",):
                assert c not in r["formatted"]
    if budget == 120:
        second = windows.where("conv_id = 1 and window = 1").first()
        assert second is None or second["formatted"].startswith("<|turn|>system\nbe kind")


def test_chat_budget_with_long_system_turns(spark):
    """Windows keep the budget whatever the system turn takes, and repeat it as long as it takes a quarter."""
    word = "word " * 8
    rows = [(c, 0, "system", "word " * n) for c, n in enumerate((3, 100, 180, 220, 3000))]
    rows += [(c, t, ("assistant", "user")[t % 2], word * (1 + (t * 7 + c) % 40)) for c in range(5) for t in range(1, 40)]
    rows += [(5, t, "user", "x" * (t * 400)) for t in range(30)] + [(6, 1, "assistant", "é" * 30_000 + "<|" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_windows(df)
    assert {r["conv_id"]: tuple(r)[1:5] for r in digests(windows).collect()} == brute_chat(rows)
    for r in windows.collect():
        assert -(-len(r["formatted"].encode()) // 4) <= 1024
        held = r["conv_id"] < 3 and r["window"] > 0
        assert r["formatted"].startswith("<|turn|>system\n") == (held or r["conv_id"] < 5 and r["window"] == 0) and r["n_repeated"] <= 3
        assert r["window"] == 0 or r["n_repeated"] >= held


def test_chat_query_and_escape(spark):
    got = op6_budgeted_chat(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(said) and got["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    rows = spark.createDataFrame([(ESCAPE + "p<|" + ESCAPE,), ("<<SYS>><|",), ("",)], "t string")
    assert rows.where(unescape(escape(F.col("t"))) != F.col("t")).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(format_windows(none)).count() == 0


@pytest.mark.parametrize("group,block", [(8192, 64), (40, 7)])
def test_topk(spark, group, block):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 8)), 2)
    x[50:120] = x[3]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1100, [float("nan")] * 8, 1), (1200, [1.0, None] * 4, 1), (None, [0.5] * 8, 1), (1300, [1e9] * 8, 1), (1400, [1.0], 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, g int").withColumn("m", F.lit(b"x")).repartition(3)
    got = collections.defaultdict(list)
    for r in topk(df, group_rows=group, block_rows=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [int(np.floor(1024 * v)) for v in e]) for i, e, _ in rows if i is not None and e and len(e) == 8 and all(v is not None and np.isfinite(v) for v in e)]
    for q, e in ok:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(e, f, strict=True)), j) for j, f in ok if j != q))[:10]
            assert got[q] == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert set(got) == {q for q, _ in ok if q % 100 == 0}
    few = topk(df.where("vec_id < 4"))
    assert few.count() == 3 and topk(df.limit(0)).count() == 0


def test_topk_of_most_frequent_length(spark):
    rows = [(0, [1.0])] + [(i, [i / 100, 1.0]) for i in range(1, 301)]
    got = topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("rank = 1").orderBy("query_id").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(100, 300), (200, 300), (300, 299)]


def test_blocks_of_clustered_vectors_are_pruned():
    """Of vectors in clusters more than half of the blocks are never scored; the results are those of a full scan."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[rng.integers(0, 60, 8000)] + rng.normal(size=(8000, 64)) * 0.03
    m, ids = np.floor(1024 * x).astype(np.int64), np.arange(8000)
    order = by_content(m, 64)
    assert sorted(order.tolist()) == ids.tolist()
    blocks = Blocks(ids, m, 64)
    q, v, s = blocks.top(ids[::100], m[::100], 10)
    floor = s.reshape(-1, 10)[:, -1]
    blocks.met = blocks.scored = 0
    q, v, s = blocks.top(ids[::100], m[::100], 10, floor)
    assert blocks.scored < 0.5 * blocks.met
    full = m[::100] @ m.T
    full[np.arange(80), ids[::100]] = -(1 << 60)
    best = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :10]
    assert (v.reshape(80, 10) == best).all() and (s.reshape(80, 10) == np.take_along_axis(full, best, 1)).all()


def test_capacity_tree_and_packing():
    rng = random.Random(7)
    tree, rooms = P.CapacityTree(50), collections.Counter()
    for _ in range(2000):
        r = rng.randint(0, 50)
        if rng.random() < 0.5 or not rooms[r]:
            rooms[r] += 1
            tree.add(r, 1)
        else:
            rooms[r] -= 1
            tree.add(r, -1)
        need = rng.randint(0, 50)
        assert tree.least(need) == min((k for k, n in rooms.items() if n and k >= need), default=-1)
    sizes = [rng.randint(1, 64) for _ in range(500)]
    row, col, n = P.best_fit_decreasing(sizes, 64)
    used = collections.defaultdict(set)
    for s, r, c in zip(sizes, row, col, strict=True):
        assert c + s <= 64 and not used[r] & set(range(c, c + s))
        used[r] |= set(range(c, c + s))
    assert n == len(used) and n <= sum(sizes) / 64 * 1.25 + 1


def test_packed_ids(spark, tmp_path):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "long " * 3000), (None, "x"), (1, "hello world"), (5, "<|endoftext|> é𝄞")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).coalesce(2)
    shards = P.write_packed(df, str(tmp_path / "p"), seq_len=64, shard_tokens=500)
    got = sorted((tuple(r)[:4] for r in P.read_packed(shards).collect()), key=str)
    enc = P._encoder(open(P.TOKENIZER, "rb").read())
    want = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or "") + [enc.n_vocab], "<u4")
        want.append((i, len(ids), -(-len(ids) // 64), hashlib.sha256(ids.tobytes()).hexdigest()))
    assert got == sorted(want, key=str)
    for r in shards.collect():
        size = r["n_rows"] * 64
        cu = np.array(r["cu_seqlens"])
        assert cu[0] == 0 and cu[-1] == size and (np.diff(cu) > 0).all() and (np.diff(cu) <= 64).all()
        pos = P.position_ids(np.array(r["resets"]), size)
        assert (pos[cu[:-1]] == 0).all() and all((pos[a:b] == np.arange(b - a)).all() for a, b in zip(cu[:-1], cu[1:], strict=True))
        assert set(range(0, size, 64)) <= set(r["resets"]) and len(np.frombuffer(r["ids"], r["dtype"])) == size
    assert P.read_packed(P.write_packed(df.limit(0), str(tmp_path / "q"))).count() == 0


def test_long_runs_are_tokenised_as_ever():
    enc = P._encoder(open(P.TOKENIZER, "rb").read())
    for run in (" ", "\n", "\t ", "\u3000", " \x1c", "a", "-", "7", "\x85"):
        for n in (P.LONG_RUN - 1, P.LONG_RUN, 3 * P.LONG_RUN):
            for text in ("x" + run * n, run * n + "y", "x" + run * n + "'s " + run * n + "-z", "é" + run * n + "\n" + run + "1"):
                assert P.encode(enc, text).tolist() == enc.encode_ordinary(text)
    for run in (" ", "\n", "a", "-", "\t\n"):
        text = "x" + run * (5_000_000 // len(run)) + "y"
        assert enc.decode(P.encode(enc, text).tolist()) == text


def test_packed_string_ids(spark, tmp_path):
    rows = [("a-1", "x" + " " * 1_000_000 + "y"), (None, None), ("7", "b")]
    shards = P.write_packed(spark.createDataFrame(rows, "doc_id string, text string"), str(tmp_path / "s"))
    got = {r["doc_id"]: r["n_tokens"] for r in P.read_packed(shards).collect()}
    assert set(got) == {"a-1", None, "7"} and got[None] == 1 and got["7"] == 2
