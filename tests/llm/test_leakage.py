from __future__ import annotations

import random

import numpy as np

from quarryline.llm import leakage as op

WORDS = [f"{a}{b}" for a in ("wal", "cur", "ban", "led", "pac", "mos", "anc", "ver") for b in ("ker", "sor", "ner", "ger", "ket", "aic", "hor", "ify", "lo", "ti")]


def item(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def noisy(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"zz{rng.randrange(10**6)}" if x < share * 2 / 3 else w)
        if share * 2 / 3 <= x < share:
            out.append(f"yy{rng.randrange(10**6)}")
    return out


def test_planted_passages(spark):
    rng = random.Random(7)
    items = [(i, item(rng)) for i in range(40)]
    docs, true = [], set()
    for d in range(400):
        background = item(rng, 150).split()
        if d % 4 == 0:
            i = rng.randrange(40)
            words = items[i][1].split()
            start = rng.randrange(0, 30)
            passage = words[start : start + rng.choice([22, 30, 60])]
            passage = noisy(rng, passage, rng.choice([0, 0, 0.1, 0.2]))
            if d % 8 == 0:
                passage = [w.upper() + rng.choice([",", "", "!"]) for w in passage]
            at = rng.randrange(150)
            background[at:at] = passage
            true.add((d, i))
        elif d % 4 == 1:
            i = rng.randrange(40)
            background[50:50] = items[i][1].split()[10:18]
        docs.append((d, " ".join(background), "clash"))
    found = {tuple(r) for r in op.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(found & true) / len(true) > 0.95 and len(found - true) <= 2


def test_radius_loses_nothing_that_verifies():
    rng = random.Random(11)
    texts = [item(rng) for _ in range(20)]
    blocks = [(i, *op.item_words(t)) for i, t in enumerate(texts)]
    near, all_ = op.ItemIndex(blocks), op.ItemIndex(blocks, radius=op.BITS)
    lost = found = 0
    for t in texts:
        for _ in range(10):
            start = rng.randrange(0, 35)
            doc = " ".join([*item(rng, 40).split(), *noisy(rng, t.split()[start : start + 24], 0.2), *item(rng, 40).split()])
            a, b = set(near.find(doc)), set(all_.find(doc))
            lost, found = lost + len(b - a), found + len(b)
    assert found > 150 and lost <= 0.01 * found


def test_a_quarter_of_changes_anywhere_is_found():
    rng = random.Random(21)
    texts = [item(rng, 40) for _ in range(30)]
    # A quarter of the words of the first items is rare: changes of these weigh most.
    texts = [" ".join(f"rare{i}x{k}" if i < 15 and k % 4 == 0 else w for k, w in enumerate(t.split())) for i, t in enumerate(texts)]
    index = op.ItemIndex([(i, *op.item_words(t)) for i, t in enumerate(texts)])
    for n in (20, 22, 25, 30, 40):
        for i, t in enumerate(texts):
            start = rng.randrange(0, 41 - n)
            words = t.split()[start : start + n]
            rare = [k for k, w in enumerate(words) if w.startswith("rare")]
            first = rng.randrange(n - n // 4 + 1)
            for k in rare[: n // 4] if rare else range(first, first + n // 4):
                words[k] = f"zz{rng.randrange(10**6)}"
            assert i in index.find(" ".join([*item(rng, 40).split(), *words, *item(rng, 40).split()])), (n, i)


def test_fewer_words_are_not_found():
    rng = random.Random(22)
    texts = [item(rng, 40) for _ in range(10)]
    index = op.ItemIndex([(i, *op.item_words(t)) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        words = t.split()[5:25]
        foreign = [f"zz{k}" for k in range(9)]
        assert index.find(" ".join([*foreign * 5, *words[:9], *foreign * 5])) == []
        assert index.find(" ".join([*foreign * 5, *words[:10], *foreign, *foreign, *words[10:], *foreign * 5])) == []
        as_units = lambda w: (np.array([index.number[x] for x in w]), np.ones(len(w), np.float32), np.arange(len(w)))
        assert op.run_within(*as_units(words[:15]), *as_units(words)) and not op.run_within(*as_units(words[:14]), *as_units(words))


def test_batch_scores_equal_single_alignments():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.integers(-1, 6, 40)
        items = [rng.integers(0, 6, n) for n in (5, 30, 17)]
        for b, best in zip(items, op.best_scores(a, items), strict=True):
            grid = np.zeros((41, len(b) + 1), int)
            for i in range(1, 41):
                for j in range(1, len(b) + 1):
                    grid[i, j] = max(0, grid[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), grid[i - 1, j] - 1, grid[i, j - 1] - 1)
            assert best == grid.max()


def test_line_prefixes_do_not_matter():
    rng = random.Random(4)
    text = item(rng)
    words = text.split()[5:29]
    lines = [f"2031-01-06T13:19:{k:02}.332070Z [info] {' '.join(words[i : i + 6])}" for k, i in enumerate(range(0, 24, 6))]
    quoted = [f"> {k}: {' '.join(words[i : i + 6])}" for k, i in enumerate(range(0, 24, 6))]
    index = op.ItemIndex([(1, *op.item_words(text)), (2, *op.item_words(item(rng)))])
    assert index.find("start\n" + "\n".join(lines) + "\nend") == [0]
    assert index.find("start\n" + "\n".join(quoted)) == [0]


def test_long_document_full_of_seeds():
    rng = random.Random(8)
    text = item(rng, 80)
    index = op.ItemIndex([(1, *op.item_words(text)), (2, *op.item_words(item(rng)))])
    phrase = " ".join(text.split()[:6])
    assert index.find(" ".join(f"{phrase} x{i} y{i} z{i} v{i} w{i} u{i} t{i} s{i}" for i in range(4000))) == []
    assert index.find(" ".join(f"{phrase} x{i} y{i}" for i in range(3000)) + " " + " ".join(text.split()[20:60])) == [0]


def test_blocks_give_the_same(spark):
    rng = random.Random(3)
    items = [(i, item(rng)) for i in range(12)]
    docs = spark.createDataFrame([(i, item(rng, 20) + " " + t) for i, t in items], "doc_id bigint, text string")
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in op.find_leaks(docs, frame).collect()}
    assert whole == {(i, i) for i in range(12)}
    assert {tuple(r) for r in op.find_leaks(docs, frame, block_words=130).collect()} == whole


def test_defined_cases(spark):
    schema = "doc_id bigint, text string"
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x\n> one two\n> three four, five SIX seven y"), (1, "x\n> one two\n> three four, five SIX seven y"), (2, None), (3, ""), (4, "one two three")], schema)
    assert {tuple(r) for r in op.find_leaks(docs, items).collect()} == {(1, 1)} and op.find_leaks(docs, items).count() == 1
    assert op.find_leaks(docs.limit(0), items).count() == 0 and op.find_leaks(docs, items.limit(0)).count() == 0
    far = " ".join(["word"] * 100_000)
    assert op.find_leaks(spark.createDataFrame([(1, far)], schema), items).count() == 0
