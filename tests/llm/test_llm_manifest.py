"""Merkle manifest and whitening, against brute force and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from randaudit.llm import merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, tree int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(show, (i, source, lang, n, text)))


def tree(nodes):
    """Levels of a tree and, for each leaf, its steps upwards: (sibling, whether it stands to the left)."""
    steps, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, members = [], []
        for k in range(0, len(nodes), 2):
            pair = nodes[k : k + 2]
            for side, inside in enumerate(own[k : k + 2]):
                for m in inside:
                    steps[m].append((pair[1 - side] if len(pair) == 2 else "", side == 1))
            up.append(sha(*pair))
            members.append([m for inside in own[k : k + 2] for m in inside])
        nodes, own = up, members
    return nodes[0], steps


def brute(rows):
    by_lang = {}
    for i, text, lang, source, n in rows:
        plain = leaf(i, source, lang, n, text)
        tampered = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        by_lang.setdefault(lang, []).append((i, plain, leaf(i, source, lang, n + 1, text) if tampered else plain))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree([r[1] for r in by_lang[lang]])
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for (i, plain, claimed), below in zip(by_lang[lang], trees[lang][1], strict=True):
            steps, node = below + above, claimed
            for sibling, left in steps:
                node = sha(sibling, node) if left else sha(node, sibling)
            out.append((i, plain, trees[lang][0], root, sha(*[s for s, _ in steps]), node, node == root))
    return sorted(out, key=repr)


def manifest(spark, rows, block=2):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS)
    return sorted(map(tuple, merkle.report(docs, block=block).collect()), key=repr)


def odd_rows():
    rng = random.Random(4)
    rows = [(k, f"text {k}", rng.choice(["en", "de", "é", "", None]), rng.choice(["a", None]), rng.choice([k, None])) for k in range(90)]
    rows += [(None, "x", "en", "a", 1), (None, None, "en", "a", 1), (7, "again", "en", "a", 3), (7, "again", "en", "a", 3), (7, "text", "en", "b", 0)]
    rows += [(200, "", "lone", "a", 0), (201, "é\n" * 50_000, "en", "", -5), (202, None, None, None, None)]
    return rows + [(k, "copy", "en", "hot", k) for k in range(300, 400)]


@pytest.mark.parametrize("block", [1, 2, 10])
def test_manifest_equals_brute_force(spark, block):
    assert manifest(spark, odd_rows(), block) == brute(odd_rows())


@pytest.mark.parametrize("rows", [[(1, "a", "en", "s", 1)], [(k, "a", str(k), "s", 1) for k in range(9)], [(14, None, None, None, 0), (2, "b", None, "s", None)]])
def test_small_manifests(spark, rows):
    assert manifest(spark, rows) == brute(rows)


def test_manifest_of_no_rows(spark):
    assert manifest(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 32])
def test_paths_keep_few_nodes(monkeypatch, n):
    leaves = [sha(str(k)) for k in range(n)]
    most, step = [0], merkle.Treehash.step

    def counted(self):
        step(self)
        most[0] = max(most[0], len(self.stack))

    monkeypatch.setattr(merkle.Treehash, "step", counted)
    height = merkle.levels(n)
    root, steps = tree(leaves)
    assert [[s for s, _ in own] for own in steps] == list(merkle.paths(leaves, height))
    assert merkle.block_root(leaves, height) == root
    assert most[0] <= height + 1


# --- whitening ---
VECTORS = "vec_id long, embedding array<float>, label int, x int"


def whitened(spark, rows, top=32):
    return whitening.report(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], VECTORS), top).collect()


def vectors(n=300, dims=6):
    rng = np.random.default_rng(3)
    return (rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) / 3).astype(np.float32)


def odd_vectors():
    rows = [(k, v.tolist()) for k, v in enumerate(vectors())]
    rows += [(1, rows[5][1]), (1, rows[5][1]), (None, rows[6][1])] + [(900 + k, rows[9][1]) for k in range(150)]
    return rows, [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0])]


def test_whitening_equals_numpy(spark):
    rows, dropped = odd_vectors()
    got = whitened(spark, rows + dropped, top=4)
    x = np.floor(np.array([v for _, v in rows], dtype=np.float32).astype(float) * 64).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    deviations = {}
    for (i, _), row, far in zip(rows, x.tolist(), ((n * x - s) ** 2).sum(axis=1).tolist(), strict=True):
        deviations.setdefault(i, set()).add(far)
    for k in range(4):
        own = [r for r in got if r.component == k + 1]
        expected = sorted(np.round(centred @ v[:, k] / np.sqrt(e[k]), 8).tolist())
        found = [r.whitened for r in own]
        assert np.allclose(sorted(found), expected, atol=1e-7) or np.allclose(sorted(-f for f in found), sorted(expected), atol=1e-7)
        assert np.allclose([r.explained for r in own], e[k] / e.sum(), rtol=1e-9)
        assert all(r.deviation in deviations[r.vec_id] for r in own)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_without_variance(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [0.5, 0.25])]) == []
    assert whitened(spark, [(k, [0.5, 0.25]) for k in range(5)]) == []
    assert whitened(spark, [(1, None)]) == []


def test_components_without_variance_have_no_rows(spark):
    rng = np.random.default_rng(1)
    flat = rng.integers(-50, 50, size=(60, 2))
    rows = [(k, [float(a), float(b), float(a + b), 1.0]) for k, (a, b) in enumerate(flat.tolist())]
    got = whitened(spark, rows)
    assert sorted({r.component for r in got}) == [1, 2] and len(got) == 120
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
