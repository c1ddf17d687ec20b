"""op5_decontamination: items of five to eight words at thousands of places of long texts."""

import numpy as np

from lumenframe.llm import decontaminate


def test_short_items_are_found_at_every_place():
    rng = np.random.default_rng(9)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n)).encode()) for n in (5, 6, 7, 8)]
    index = decontaminate.ItemIndex(items, 5, 0.8)
    for k, (_, text) in enumerate(items):
        for _ in range(1500):
            words = [f"w{i}" for i in rng.integers(0, 100_000, 120)]
            at = int(rng.integers(0, 121))
            found = index.matches(" ".join(words[:at] + [text.decode()] + words[at:]).encode())
            assert [f[0] for f in found] == [k]


def test_one_of_many_short_items_with_a_word_changed():
    words = [f"a{i}" for i in range(9)]  # five shingles; the last word changed leaves four
    index = decontaminate.ItemIndex([(1, " ".join(words).encode())], 5, 0.8)
    for at in range(300):
        text = [f"t{at}x{i}" for i in range(300)]
        assert [f[1:] for f in index.matches(" ".join(text[:at] + words[:8] + text[at:]).encode())] == [(4, 5)]
        assert index.matches(" ".join(text[:at] + words[:7] + text[at:]).encode()) == []


def test_items_shorter_than_a_shingle_are_found_inside_long_texts():
    items = [(1, b"Capital of France, Paris"), (2, b"forty two"), (3, b"one"), (4, b"never in it"), (5, b"")]
    index = decontaminate.ItemIndex(items, 5, 0.8)
    words = [f"w{i}" for i in range(5000)]
    for at in (0, 1, 2500, 4999, 5000):
        text = " ".join(words[:at] + ["capital", "of", "france", "paris"] + words[at:]).encode()
        assert index.matches(text) == [(0, 1, 1)]
        assert index.matches(text.replace(b"of france", b"of france,\n")) == [(0, 1, 1)]
        assert index.matches(text.replace(b"of france", b"of new france")) == []
    assert [f[0] for f in index.matches(b"forty two")] == [1] and [f[0] for f in index.matches(b"twenty-one")] == [2] and index.matches(b"ones fortytwo") == []
