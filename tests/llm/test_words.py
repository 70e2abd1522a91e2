"""Words that a polynomial modulo 2**64 takes as equal."""

import numpy as np
import pyarrow as pa

from furrow.llm import words
from furrow.llm.decontaminate import contaminated
from furrow.llm.ngram_join import similar_components
from furrow.llm.substring_dedup import remove_repeats


def thue_morse(bits: int) -> tuple[str, str]:
    one = "".join("ab"[k.bit_count() & 1] for k in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_long_words_have_different_hashes():
    for bits in (9, 10, 11, 12):
        block, = words.blocks(pa.array([" ".join(thue_morse(bits))]))
        assert block.hash[0] != block.hash[1]


def test_powers_beyond_the_kept_ones():
    powers = words._Powers(words._BASE)
    up, down = powers.upto(3 * words.KEPT_POWERS)
    assert len(powers.up) <= words.KEPT_POWERS and len(up) == 3 * words.KEPT_POWERS
    assert (up[[5, -1]] * down[[5, -1]] == np.uint64(1)).all()


def test_operators_tell_them_apart(spark):
    x, y = thue_morse(11)
    common = [f"w{k}" for k in range(49)]
    docs = spark.createDataFrame([(1, " ".join([*common, x])), (2, " ".join([*common, y])), (3, " ".join([*common, x]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 50}
    short = spark.createDataFrame([(1, f"p {x} q r"), (2, f"p {y} q r"), (3, f"p {x} q r")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_components(short).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, f"p {x} q r")], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated(short, items).collect()) == [1, 3]
