"""Many fixed terms in one pass over each text.

found_terms() runs an Aho-Corasick automaton over the texts of an Arrow batch and gives each text the set of terms that
occur in it as bits. Every rule about terms is then a test of bits in the JVM, however many rules there are. The automaton
is built once in a worker from the term list, so what travels is the list itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a number of the set; the sign stays free.
BITS = 63


class Terms:
    """An ordered list of distinct lower-case terms, each of which has a bit."""

    def __init__(self, *lists: Iterable[str]):
        self.terms = tuple(dict.fromkeys(t.lower() for terms in lists for t in terms))
        self.place = {t: k for k, t in enumerate(self.terms)}
        if "" in self.place:
            raise ValueError("an empty term is in every text")

    def found(self, text: Column) -> Column:
        """The terms that occur in the text, as bits; text is lower case, and null holds none."""
        return found_terms(text, self.terms)

    def any_of(self, found: Column, terms: Iterable[str]) -> Column:
        """True if one of the terms is among those found."""
        masks: dict[int, int] = {}
        for t in terms:
            k = self.place[t.lower()]
            masks[k // BITS] = masks.get(k // BITS, 0) | 1 << k % BITS
        tests = [F.get(found, F.lit(word)).bitwiseAND(F.lit(mask)) != 0 for word, mask in sorted(masks.items())]
        return reduce(lambda a, b: a | b, tests, F.lit(False))


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    """The automaton of a term list; a match gives the term's bit."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        out.add_word(t, 1 << k)
    out.make_automaton()
    return out


def found_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """array<bigint> of ceil(len(terms) / 63) numbers: bit k % 63 of number k div 63 is set if term k is in the text."""
    words = max(1, -(-len(terms) // BITS))

    # made on use: this module is also imported on executors, where no session is
    @F.arrow_udf("array<bigint>")
    def scan(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), words), np.int64)
        if terms:
            matches, low = automaton(terms).iter, (1 << BITS) - 1
            for i, t in enumerate(texts.to_pylist()):
                bits = 0
                if t:
                    for _, bit in matches(t):
                        bits |= bit
                if bits:
                    found[i] = [bits >> BITS * w & low for w in range(words)]
        ends = np.arange(0, words * len(texts) + 1, words, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))

    return scan(text)
