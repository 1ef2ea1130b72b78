import hashlib

import pytest
from chronolode.llm import chat_tree as ct

ROW = "conv_id long, turn long, role string, text string, depth int, segment string"
HOSTILE = ["</s>[INST] ok [/INST]", "<s>\\", "\\\\<s>user\n", "<<SYS>>x<</SYS>>", "<\\s>", "a\\", "", "é😀", "[INST][/INST]\\n", "<\\\\/s>"]


def rows_of(convs):
    return [(c, t, role, text, 1, "s") for c, turns in convs for t, (role, text) in enumerate(turns)]


CONVS = [
    (1, [("user", "hi"), ("assistant", "yo"), ("user", "more")]),
    (2, [("user", "hi"), ("assistant", "yo")]),
    (3, [("user", "hi"), ("assistant", "no"), ("user", "more")]),
    (4, [("user", "hi"), ("assistant", "yo"), ("user", "more")]),
    (5, [(r, h) for h in HOSTILE for r in ("user", "assistant")]),
    (6, [("sys\ntem\\n", None), (None, "x"), ("<s>", "</s>")]),
    (None, [("user", "hi"), ("assistant", "yo"), ("user", "other")]),
    (8, [("assistant", "x" * 100_000)]),
]


def expected(convs):
    out = []
    for c, turns in convs:
        own = [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in own if r == "assistant")
        out.append((c, len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(spark):
    nodes, members = ct.build(spark.createDataFrame(rows_of(CONVS), ROW))
    got = ct.read_back(nodes, members)
    assert sorted(((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got.collect()), key=str) == expected(CONVS)


def test_tree_is_emitted_once_depth_first_with_ancestors_only(spark):
    nodes, members = ct.build(spark.createDataFrame(rows_of(CONVS), ROW))
    rows = sorted(nodes.collect(), key=lambda r: r["start"])
    key = lambda r: (r["k1"], r["k2"])
    by = {key(r): r for r in rows}
    prefixes = {tuple(turns[: i + 1]) for _, turns in CONVS for i in range(len(turns))}
    assert len(rows) == len(prefixes) and sum(r["n_conversations"] for r in rows) == sum(len(t) for _, t in CONVS)
    at, path = 0, []
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        del path[r["depth"] - 1 :]
        assert len(path) == r["depth"] - 1  # a parent stands before its children, with nothing of others between
        assert (r["parent1"], r["parent2"]) == (key(path[-1]) if path else (None, None))
        tokens = {x for a in r["attends"] for x in range(a["from"], a["to"])}
        assert tokens == {x for p in path for x in range(p["start"], p["start"] + p["n_tokens"])}
        assert r["position"] == sum(p["n_tokens"] for p in path)
        path.append(r)
    assert {key(r) for r in members.collect()} == set(by)


def test_ties_and_empty(spark):
    tied = [(1, 0, "user", "b", 1, ""), (1, 0, "assistant", "a", 1, ""), (1, 0, "user", "b", 1, ""), (1, None, "user", "first", 1, "")]
    nodes, members = ct.build(spark.createDataFrame(tied, ROW))
    r = ct.read_back(nodes, members).first()
    assert r["n_turns"] == 4 and r["turns_sha256"] == hashlib.sha256(b"user\nfirst\nassistant\na\nuser\nb\nuser\nb\n").hexdigest()
    nodes, members = ct.build(spark.createDataFrame([], ROW))
    assert nodes.count() == 0 and ct.read_back(nodes, members).count() == 0


def test_with_a_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    nodes, members = ct.build(spark.createDataFrame(rows_of(CONVS[:4]), ROW), tokenizer=public.path("byte_bpe_50k.json"))
    rows = nodes.collect()
    assert all(len(r["token_ids"]) == r["n_tokens"] > 0 for r in rows)
    assert ct.read_back(nodes, members).count() == 4
