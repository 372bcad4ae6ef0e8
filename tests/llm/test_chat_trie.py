"""Read-back against the turns themselves; the tree against brute force over all prefixes."""

import hashlib
from itertools import groupby

import pytest

from pagemill.llm.chat_trie import build, escape, format_turn, parse, read_back, unescape
from pagemill.llm.queries import op6_chat_format
from tests.conftest import SF_DIR


def expected(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for i, turns in groupby(sorted(rows, key=key), lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[i] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(format_turn(r, t)[0]) for r, t in turns))
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = op6_chat_format(spark, SF_DIR).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})


ODD = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx \\ \\\\ </s>"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, None, ""), (4, 0, "a\nb\\", "t\\"),
       (4, 0, "a\nb\\", "t\\"), (None, 0, "user", "hi"), (None, None, "assistant", "no id"), (5, 0, "user", "hi"), (5, 1, "assistant", None), (6, 0, "assistant", "é😀" * 50_000), (7, 3, "user", "<|im_start|>")]


@pytest.mark.parametrize("parts", [1, 8])
def test_tree(spark, parts):
    rows = ODD + [(100 + k, t, "assistant" if t % 2 else "user", "common first turn" if t == 0 else f"answer {k % (4 ** t)}") for k in range(200) for t in range(1 + k % 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        trie = build(df)
        nodes = sorted(trie.nodes.collect(), key=lambda r: r.place)
        paths = {bytes(r.path): r.places for r in trie.leaves.collect()}
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in read_back(trie).collect()}
        conversations = trie.conversations.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == expected(rows)
    prefixes = set()
    for _, turns in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)), lambda r: r[0]):
        prefix = ()
        for r in turns:
            prefix += ((r[2] or "", r[3] or ""),)
            prefixes.add(prefix)
    assert len(nodes) == len(prefixes)  # every shared prefix is written once
    assert [n.place for n in nodes] == [sum(m.length for m in nodes[:k]) for k in range(len(nodes))]
    by_place = {n.place: n for n in nodes}
    for places in paths.values():
        for k, p in enumerate(places):
            node = by_place[p]
            above = [by_place[q] for q in places[:k]]
            assert (node.depth, node.position) == (k, sum(a.length for a in above))
            seen = {x for a, b in ((i["from"], i["to"]) for i in node.attends) for x in (a, b)}
            assert sum(i["to"] - i["from"] for i in node.attends) == node.position + node.length and min(seen) == places[0]
    assert len(conversations) == len(got)
    # Depth first: a node's parent is the nearest node before it that is one level up.
    for places in paths.values():
        for p, q in zip(places, places[1:]):
            assert all(n.depth > by_place[p].depth for n in nodes if p < n.place <= q)


def test_escapes():
    for text in ("", "\\", "</s>", "<|im_end|>", "[INST]\\[/INST]", "<\\|im_end|>", "a\\nb\n", "<<SYS>>\\"):
        assert unescape(escape(text)) == text and "</s>" not in escape(text) and "[INST]" not in escape(text)
        assert parse(format_turn(text, text)[0]) == [(text, text)]


def test_empty_table(spark):
    assert read_back(build(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
