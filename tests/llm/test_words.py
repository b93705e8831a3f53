import random
import re

import numpy as np
import pyarrow as pa

from petrigrid.llm import common as C

ALPHABET = "aB z9\t\n\r\x0b\x0c.,-é日  \x00\x7f"


def pieces(texts, rule, fold):
    out = []
    for i, j, data, offsets in C.slices(pa.array(texts, pa.string()), 64):
        w = C.Words(data, offsets, rule, fold)
        found = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)]
        out += [found[w.first[k] : w.first[k + 1]] for k in range(j - i)]
        assert len({(h, t) for h, t in zip(w.hash.tolist(), found, strict=True)}) == len(set(found)) == len(set(w.hash.tolist()))
    return out


def test_words_follow_the_patterns():
    rng = random.Random(3)
    texts = [None, ""] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90))) for _ in range(300)]
    plain, folded = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert pieces(texts, C.PLAIN, False) == [plain.findall(t or "") for t in texts]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert pieces(texts, C.FOLDED, True) == [folded.findall((t or "").translate(lower)) for t in texts]


def test_joined_leaves_single_spaces():
    data, offsets = C.buffers(pa.array(["a  b\tc", None, " d ", "e"]))
    w = C.Words(data, offsets, C.PLAIN)
    text, cut = w.joined(np.array([True, False, True, True, False]))
    assert [bytes(text[a:b]).decode() for a, b in cut] == ["a c", "", "d", ""]


def test_groups_stay_whole():
    keys = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5, 5, 5]
    batches = [pa.record_batch({"k": keys[i : i + 3], "v": list(range(len(keys)))[i : i + 3]}) for i in range(0, len(keys), 3)]
    seen, rows = set(), 0
    for t in C.groups(iter(batches), "k"):
        own = set(t.column("k").to_pylist())
        assert not own & seen
        seen |= own
        rows += t.num_rows
    assert rows == len(keys)


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 4000), (4500, 5000)]
    got = {r["id"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {5000: 4000, 4500: 4000}
    assert got == want
    assert C.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
