import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvartal.llm.transducer import Transducer


def ordinals(t, strings):
    size = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    return t.walk(data, np.cumsum(size) - size, size, np.full(len(size), t.root), np.zeros(len(size), np.int64)).tolist()


words = st.binary(max_size=6).map(lambda b: bytes(c % 3 + 97 for c in b))


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1), st.lists(words, min_size=1))
def test_ordinals(keys, others):
    keys = sorted(set(keys))
    t = Transducer.from_bytes(Transducer.build(keys).to_bytes())
    assert ordinals(t, keys) == list(range(len(keys))) and len(t) == len(keys)
    assert ordinals(t, others) == [keys.index(x) if x in keys else -1 for x in others]


def futures(keys):
    """States of the least automaton: different sets of what may follow a prefix."""
    prefixes = {k[:i] for k in keys for i in range(len(k) + 1)}
    return len({frozenset(k[len(p) :] for k in keys if k.startswith(p)) for p in prefixes})


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1))
def test_least_number_of_states(keys):
    keys = sorted(set(keys))
    assert Transducer.build(keys).states == futures(keys)


@pytest.mark.parametrize("keys", [[b""], [b"x" * 5000, b"x" * 4999 + b"y"], ["é".encode(), "ü".encode(), b"\xff"], []])
def test_edges(keys):
    keys = sorted(keys)
    t = Transducer.build(keys)
    assert ordinals(t, [*keys, b"x" * 4998]) == [*range(len(keys)), -1]


def test_prefix_leads_on():
    keys = sorted([b"de\0a", b"de\0ab", b"en\0a", b"en\0b"])
    t = Transducer.build(keys)
    state, before = t.lead(b"en\0")
    data = np.frombuffer(b"abc", np.uint8)
    got = t.walk(data, np.array([0, 1, 2]), np.array([1, 1, 1]), np.full(3, state), np.full(3, before))
    assert got.tolist() == [2, 3, -1] and t.lead(b"fr\0") == (-1, 0)
