"""Near-duplicate groups of families of similar texts, against all pairs: nothing that may link is left untried."""

import itertools
import random

import numpy as np
import pytest

from quorumlake.llm import near_dedup

SCHEMA = "doc_id long, text string"


def family(rng, size, pairs, core=169, own=35, more=9):
    """Texts that share a core (similarity 0.70, no link); the first 2 * pairs share nine words more by twos (0.77, a link)."""
    word = lambda: f"w{rng.getrandbits(48):x}"
    shared = [word() for _ in range(core)]
    extra = [[word() for _ in range(more)] for _ in range(pairs)]
    return [" ".join(shared + (extra[i // 2] if i < 2 * pairs else []) + [word() for _ in range(own - (more if i < 2 * pairs else 0))]) for i in range(size)]


def star(rng):
    """A text and six that each replace another run of 23 of its words (0.76 to the text, 0.57 to each other), with a copy of each near it."""
    word = lambda: f"w{rng.getrandbits(48):x}"
    hub = [word() for _ in range(204)]
    out = [hub]
    for i in range(6):
        arm = hub[: 30 * i + 6] + [word() for _ in range(23)] + hub[30 * i + 29 :]
        out += [arm, arm[:-6] + [word() for _ in range(6)]]
    return [" ".join(x) for x in out]


def exact_groups(texts, families):
    """Smallest id of each text's component over all pairs inside the families, which share no words with each other."""
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for members in families:
        for i, j in itertools.combinations(members, 2):
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def laid_out(parts):
    ends = np.cumsum([0, *map(len, parts)])
    return list(itertools.chain(*parts)), [range(a, b) for a, b in itertools.pairwise(ends)]


def groups_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    return {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}


def test_a_likelier_partner_hides_no_pair(spark):
    rng = random.Random(11)
    texts, families = laid_out([family(rng, 12, 1) for _ in range(20)])
    assert groups_of(spark, texts) == exact_groups(texts, families)


@pytest.mark.parametrize("block", [60])
def test_large_cells_are_compared_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GATHERED", 5000)
    rng = random.Random(12)
    texts, families = laid_out([family(rng, 400, 40)])
    wanted = exact_groups(texts, families)
    assert len(set(wanted.values())) == len(texts) - 40
    assert groups_of(spark, texts) == wanted


def test_all_pairs_of_chained_families_are_tried(spark):
    rng = random.Random(13)
    texts, families = laid_out([*(star(rng) for _ in range(30)), *(family(rng, 20, 2) for _ in range(10))])
    assert groups_of(spark, texts) == exact_groups(texts, families)


def test_a_template_of_1400_texts(spark):
    """Texts of one template with about 60 of 400 words changed, in pairs that share most changes: each pair's link is found among a million others."""
    rng = random.Random(14)
    word = lambda: f"w{rng.getrandbits(48):x}"
    template = [word() for _ in range(400)]
    texts = []
    for _ in range(700):
        at = rng.randrange(0, 340)
        changed = template[:at] + [word() for _ in range(60)] + template[at + 60 :]
        texts += [" ".join(changed), " ".join(changed[:-30] + [word() for _ in range(30)] if at < 300 else [word() for _ in range(30)] + changed[30:])]
    assert groups_of(spark, texts) == exact_by_numbers(texts)


def exact_by_numbers(texts):
    """exact_groups of one large family, with 0/1 rows of shingles in place of sets."""
    names: dict[tuple, int] = {}
    sets = [[names.setdefault(tuple(w[p : p + 5]), len(names)) for p in range(len(w) - 4)] for w in (t.split() for t in texts)]
    held = np.bincount(np.concatenate(sets), minlength=len(names))
    often = {x: i for i, x in enumerate(np.flatnonzero(held > 1))}
    m = np.zeros((len(texts), len(often)), dtype=np.float32)
    for i, own in enumerate(sets):
        m[i, [often[x] for x in own if x in often]] = 1
    common, n = m @ m.T, np.array([len(set(x)) for x in sets])
    near = 100 * common >= 75 * (n[:, None] + n - common)
    root = np.arange(len(texts))
    while True:
        low = np.array([root[row].min() for row in near])
        if (low == root).all():
            return {i: int(x) for i, x in enumerate(root)}
        root = low
