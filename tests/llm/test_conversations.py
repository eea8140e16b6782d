"""Chat formatting, conversation repair and the prefix trie against plain versions, and odd tables."""

import hashlib
import itertools
import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, queries, repair, trie

TYPES = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    long = "word. " * 400_000
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", None), (2, 0, None, ""), (2, 1, "assistant", long), (None, 0, "user", "x"), (None, None, None, None), (3, 5, "tool: a", " \t\n"), (3, 5, "tool: a", "b"), (-4, 2, "", "?")]
    return spark.createDataFrame(rows, TYPES).select("*", *[F.lit("x").alias(c) for c in ("part", "there", "pos", "node", "audit", "at", "said", "parent")])


def in_order(df, role="", text=""):
    """Turns by conversation in the stated order."""
    out = {}
    for r in df.collect():
        out.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, (r["role"] or role), (r["text"] or text)))
    return {k: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for k, v in out.items()}


def plain_format(turns):
    said = ""
    for role, text in turns:
        esc = lambda t: t.replace("\\", "\\\\").replace("</turn>", "\\</turn>")
        marks = lambda t: "".join("\\#" if t.startswith("###", i) else c for i, c in enumerate(t))
        label = role.capitalize() if role in ("system", "user", "assistant") else "=" + marks(esc(role)).replace(":", "\\:")
        said += f"### {label}: {marks(esc(text))}</turn>\n"
    return said


PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "####", "</turn>", "</turn", "<", ">", "\n", ": ", "=", "é", "語", "a b", "### Assistant: ", "😀"]) | st.text(max_size=4), max_size=6).map("".join).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "User", "=x", ""]) | PIECES, PIECES), min_size=1, max_size=5))
def test_formatted_turns_read_back(turns):
    roles, texts = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    out, edge, at, size = chat.assemble(roles, texts)
    whole = out.tobytes()
    assert whole.decode() == plain_format(turns)
    assert list(chat.read_turns(whole.decode())) == turns
    assert chat.read_loss(whole, [{"start": a, "length": n} for a, n in zip(at, size, strict=True)]) == [t for _, t in turns]
    assert list(edge) == [len(plain_format(turns[:i]).encode()) for i in range(len(turns) + 1)]


def test_sliced_arrow_columns():
    texts, roles = pa.array(["skip", "a###b", None, "c"]), pa.array(["user", "user", "assistant", None])
    out, edge, *_ = chat.assemble(roles.slice(1), texts.slice(1))
    assert out.tobytes().decode() == plain_format([("user", "a###b"), ("assistant", ""), ("", "c")])


@pytest.mark.parametrize("part_bytes", [chat.PART_BYTES, 20])
def test_chats_of_odd_tables(spark, odd, part_bytes):
    many = odd.unionByName(spark.range(60).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("ab###"), F.col("id").cast("int")).alias("text")), allowMissingColumns=True)
    want, got = in_order(many), {}
    rows = chat.format_chats(many, part_bytes=part_bytes).collect()
    for r in sorted(rows, key=lambda r: r["part"]):
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(want) and max(r["part"] for r in rows) >= (part_bytes == 20)
    for k, parts in got.items():
        assert [p["part"] for p in parts] == list(range(len(parts))) and sum(p["n_turns"] for p in parts) == len(want[k])
        assert "".join(p["formatted"] for p in parts) == plain_format(want[k])
        assert [t for p in parts for t in chat.read_loss(p["formatted"].encode(), p["loss"])] == [t for r, t in want[k] if r == "assistant"]
    for r in chat.digests(chat.format_chats(many, part_bytes=part_bytes)).collect():
        turns = want[r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(t for a, t in turns if a == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(plain_format(turns)))
    assert chat.digests(chat.format_chats(odd.where("false"))).count() == 0


def brute(rows):
    """Cheapest (cost, audit) of rows (initial, fault) over all edits with at most two insertions in a gap."""
    best = None
    choices = [("K", "Ru", "Ra", "D")] * len(rows)
    gaps = [("", "u", "a", "uu", "ua", "au", "aa")] * (len(rows) + 1)
    for edits in itertools.product(*choices):
        if any(e != "D" and f in (repair.BLANK, repair.DUPLICATE) for e, (_, f) in zip(edits, rows, strict=True)):
            continue
        for put in itertools.product(*gaps):
            cost, audit, roles = 0, "", ""
            for i in range(len(rows) + 1):
                cost, audit, roles = cost + 3 * len(put[i]), audit + "I" * len(put[i]), roles + put[i]
                if i < len(rows):
                    e, (initial, fault) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 3, "D": 4}[e[0]] + (3 if e != "D" and fault == repair.CUT_OFF else 0)
                    roles += "" if e == "D" else e[1] if e[0] == "R" else (initial or "x")
            core = roles[1:] if roles[:1] == "s" else roles
            if (roles == "" or (core and core == "ua" * (len(core) // 2))) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_cheapest_edits_of_all_short_conversations():
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in range(4)]
    for n in (0, 1, 2):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.cheapest(list(rows)) == brute(list(rows))
    r = random.Random(7)
    for _ in range(60):
        rows = [r.choice(kinds) for _ in range(3)]
        assert repair.cheapest(rows) == brute(rows)


def test_long_conversations_are_repaired():
    rows = [("u", repair.GOOD), ("a", repair.CUT_OFF), ("u", repair.BLANK)] * 1000
    cost, audit = repair.cheapest(rows)
    assert (cost, audit) == (7000, "KKD" * 1000)


def test_repair_of_odd_tables(spark, odd):
    want, got = in_order(odd), {r["conv_id"]: r for r in repair.repair(odd).collect()}
    assert set(got) == set(want)
    for k, turns in want.items():
        found = repair.faults(turns)
        r = got[k]
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(found.count(f) for f in (repair.BLANK, repair.DUPLICATE, repair.CUT_OFF))
        assert (r["cost"], r["audit"]) == brute([(t[0][:1] if t[0][:1] in "sua" else "", f) for t, f in zip(turns, found, strict=True)])
        roles = "".join(t["role"][0] for t in r["turns"])
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)
    assert got[1]["duplicate"] == 1 and got[1]["gaps"] == 0 and got[3]["blank"] == 1
    ghosts = repair.repair(odd.withColumn("there", F.lit(False)), present="there").collect()
    assert len(ghosts) == len(want) and all((r["cost"], r["audit"], r["gaps"], list(r["turns"])) == (0, "", 0, []) for r in ghosts)
    assert repair.repair(odd.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {c}. {t}!") for c in range(40) for t in range(6)]
    got = {}
    for r in queries.damaged(spark.createDataFrame(rows, TYPES)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    for c, t, role, text in rows:
        lot, out = zlib.crc32(f"{c}:{t}".encode()) % 20, got[c, t]
        assert len(out) == (2 if lot == 3 else 1) and all(r["there"] == (lot != 0) for r in out)
        assert out[0]["role"] == ("user" if lot == 4 else role) and out[0]["text"] == {1: "", 2: f"Text {c} {t}"}.get(lot, text)


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text)]} by plain dictionaries."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, out = {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = {}, {}
    for k, m in members.items():
        words = len("".join(" " if c in " \t\n\x0b\x0c\r" else "x" for c in k[-1][1]).split()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + (len(m) - 1) * words
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_dict(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def own_trie(rows):
    turns = trie.turn_rows(rows)
    return trie.prefix_trie(turns, turns.select("conv_id").distinct())


def test_trie_of_random_conversations(spark):
    r = random.Random(3)
    convs = {c: [(r.choice(["user", "assistant"]), r.choice(["a b", "c", "d  e\nf"])) for _ in range(r.randint(1, 6))] for c in range(-20, 60)}
    convs |= {100: [("user", f"t{i}") for i in range(150)], 101: [("user", f"t{i}") for i in range(90)] + [("assistant", "z z")], 102: [("user", f"t{i}") for i in range(150)]}
    rows = spark.createDataFrame([(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)], TYPES)
    assert as_dict(own_trie(rows)) == plain_trie(convs)


def test_trie_of_odd_tables(spark, odd):
    want = {k: v for k, v in in_order(odd).items() if k is not None}
    got = as_dict(own_trie(odd))
    if len({len(v) for v in want.values()}):  # ties go by content, whose order is that of digests
        assert {d: n for (_, d), (_, n, *_) in got.items() if d == 0} == {0: len(want)}
        assert max(d for _, d in got) == max(len(v) for v in want.values())
    assert own_trie(odd.where("false")).count() == 0


def test_query_of_rebuilt_conversations(spark, tmp_path):
    """Bases that are absent, short or the conversation itself; conversations left without a turn."""
    r = random.Random(5)
    own = {c: [(r.choice(["user", "assistant"]), r.choice(["a b", "c"])) for _ in range(r.randint(1, 5))] for c in (0, 1, 2, 3, 4, 5, 21, 22, 23, 24, 40, 41, 42, 43, 44, 45, 46, 59)} | {c: [("user", "x")] for c in range(61, 69)}
    spark.createDataFrame([(c, t, *turn) for c, turns in own.items() for t, turn in enumerate(turns)], TYPES).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not v for v in convs.values())
    assert as_dict(queries.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(convs)


@pytest.mark.parametrize("shape", ["chain", "star", "broom", "random"])
def test_subtree_totals(spark, shape):
    n, r = 400, random.Random(1)
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "broom": lambda i: i - 1 if i < 200 else 199, "random": lambda i: r.randrange(max(0, i - 5), i)}[shape]
    parent = [None, *[up(i) for i in range(1, n)]]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    total = list(range(n))
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    node = lambda i: None if i is None else (i, depth[i])
    tree = spark.createDataFrame([(node(i), node(parent[i]), i) for i in range(n)], "node struct<conv:long,depth:long>, parent struct<conv:long,depth:long>, v long")
    assert {row["node"]["conv"]: row["v"] for row in trie.subtree_totals(tree, ["v"]).collect()} == dict(enumerate(total))
