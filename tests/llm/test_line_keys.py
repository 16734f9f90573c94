import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from brindle.llm import lines
from brindle.llm.common import Tables


def test_unlike_lines_write_few_rows(spark, monkeypatch):
    """Keys move in records, so that tables hold a few rows for a line, not one for each of its keys."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    docs = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(5))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows, write = [], Tables.write

    def counted(self, frame, label="t"):
        out = write(self, frame, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(Tables, "write", counted)
    assert all(r.n_lines == 5 and not r.n_removed for r in lines.dedup_lines(df).collect())
    assert sum(rows) < 5 * 1000


def made(rnd, sizes, parts):
    """(ids, keys, sketch): lines of which groups share the last key; lines of a group are unlike or nearly alike."""
    n = sum(sizes)
    ids = np.array(rnd.sample(range(-(1 << 60), 1 << 60), n), np.int64)
    words = lambda *shape: np.array([rnd.getrandbits(64) for _ in range(int(np.prod(shape)))], np.uint64).reshape(shape)
    keys, sketch, at = words(n, lines.BANDS), words(n, lines.SKETCH), 0
    for k, size in enumerate(sizes):
        keys[at : at + size, -1] = keys[at, -1]
        for j in range(at + 1, at + size):
            if rnd.random() < 0.3:
                sketch[j] = sketch[rnd.randrange(at, j)] ^ np.uint64(rnd.getrandbits(8))
        at += size
    return ids, keys, sketch


def test_every_pair_of_a_key_that_may_be_similar_is_met():
    rnd = random.Random(3)
    sizes = [1] * 50 + [2, 2, 3, 5, 9, lines.ALL - 1, lines.ALL, lines.ALL + 1, 90, lines.MANY - 2, lines.MANY, lines.MANY + 1, lines.MANY + 40]
    parts = 5
    ids, keys, sketch = made(rnd, sizes, parts)
    bits = dict(zip(ids.tolist(), lines._bits(sketch).tolist(), strict=True))
    held = defaultdict(list)
    cuts = [0, len(ids) // 2, len(ids) - 100, len(ids)]  # as of several tasks
    for a, b in zip(cuts, cuts[1:], strict=False):
        # a key of many lines in one task alone is told to its part as well
        for p, kind, data in lines._dealt(ids[a:b], keys[a:b], sketch[a:b], parts):
            held[p, kind].append(data)
    by_key, pairs = defaultdict(set), set()
    for (_, kind), data in held.items():
        if kind == 2:
            many = np.frombuffer(b"".join(data), lines._MANY)
            for k, x in zip(many["key"].tolist(), many["line"].tolist(), strict=True):
                by_key[k].add(x)
    for p in range(parts):
        rows, flags = (np.frombuffer(b"".join(held[p, k]), lines._RECORD) for k in (0, 1))
        for batch in lines._met(p, rows, flags):
            for k, x, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                by_key[k].add(x) if y is None else pairs.add((x, y))
    sketched = [np.frombuffer(b"".join(held[p, 3]), lines._SKETCHED) for p in range(parts)]
    assert {(x, *s) for part in sketched for x, s in zip(part["line"].tolist(), part["sketch"].tolist(), strict=True)} == {(x, *s) for x, s in zip(ids.tolist(), sketch.tolist(), strict=True)}
    assert all(x < y and (bits[x] ^ bits[y]).bit_count() <= lines.UNLIKE_BITS for x, y in pairs)
    at, close = 0, 0
    groups = list(by_key.values())
    for size in sizes:
        group = sorted(ids[at : at + size].tolist())
        at += size
        whole = any(set(group) <= g for g in groups)
        assert whole or size <= lines.MANY
        for k, x in enumerate(group):
            for y in group[k + 1 :]:
                if (bits[x] ^ bits[y]).bit_count() <= lines.UNLIKE_BITS:
                    close += 1
                    assert (x, y) in pairs or any(x in g and y in g for g in groups)
                    assert size > lines.ALL or (x, y) in pairs
    assert close > 500


def test_keys_of_several_components_are_held_in_any_batches():
    rnd = random.Random(5)
    rows, sets = [], {}
    for k in range(40):
        size = rnd.choice((2, 3, 17, 60))
        base = [rnd.getrandbits(64) for _ in range(lines.SKETCH)]
        own = [rnd.getrandbits(31) for _ in range(150)]
        for x in sorted(rnd.sample(range(5000), size)):
            sketch = [b ^ rnd.getrandbits(64) & rnd.choice((0, 0x1111, 0x1111111111111111)) for b in base]
            noise = rnd.choice((0, 0.06))
            own_set = sorted({rnd.getrandbits(31) if rnd.random() < noise else h for h in own})
            sets[k, x] = (sketch, own_set if rnd.random() < 0.7 else None, rnd.randrange(3))
            rows.append((k, x, sets[k, x][2], [s - (1 << 64) if s >> 63 else s for s in sketch], sets[k, x][1]))
    want = set()
    for k, x in sets:
        for other, y in sets:
            if other == k and x < y:
                (s, own, root), (t, its, there) = sets[k, x], sets[k, y]
                unlike = sum((a >> b & 15) != (c >> b & 15) for a, c in zip(s, t, strict=True) for b in range(0, 64, 4))
                if root == there or unlike > int((1 - lines.AGREE) * 64):
                    continue
                both = len({*own} & {*its}) if own and its else 0
                each = len(own) + len(its) if own and its else 0
                if own and its and both + lines.SLACK < 0.8 * (each - both - lines.SLACK):
                    continue
                want.add((x, y, bool(own and its and both - lines.SLACK >= 0.8 * (each - both + 3 * lines.SLACK))))
    schema = pa.schema([("key", pa.int64()), ("line", pa.int64()), ("root", pa.int64()), ("sketch", pa.list_(pa.int64())), ("set", pa.list_(pa.int32()))])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for size in (1, 7, 10_000):
        got = [r for b in lines._across(iter(table.to_batches(max_chunksize=size))) for r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)]
        assert set(got) == want and len(want) > 20
    assert {sure for *_, sure in want} == {True, False}


def test_an_empty_bin_takes_the_first_value_found():
    rnd = np.random.default_rng(2)
    sig = rnd.integers(0, 1 << 40, (30, lines._BINS)).astype(np.uint64)
    sig[rnd.random(sig.shape) < rnd.random((30, 1))] = lines._EMPTY
    sig[:, 0] = 5
    want = sig.copy()
    for r, b in zip(*np.nonzero(sig == lines._EMPTY), strict=True):
        want[r, b] = next((v for v in (sig[r, step[b]] for step in lines._BORROW) if v != lines._EMPTY), lines._EMPTY)
    lines._borrow(sig)
    assert (sig == want).all()
