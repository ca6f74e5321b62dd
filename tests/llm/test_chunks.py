"""Keyed look-ups between chunks, with whole and with half hashes."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spire.llm import chunks as C


def test_half_hashes_say_yes_too_often_but_never_no():
    one = np.array([(7 << 32) | 1, (8 << 32) | 3, (9 << 32) | 5], np.uint64)
    two = np.array([(7 << 32) | 2, (9 << 32) | 5], np.uint64)  # the first shares half a hash only
    mine, other = C.Distinct.among(one, 1), C.Distinct.among(two, 1)
    whole = [d.messages(i) for i, d in enumerate((mine, other))]
    half = [d.messages(i, short=True) for i, d in enumerate((mine, other))]
    assert len(half[0].column("hashes")[0].as_py()) * 2 == len(whole[0].column("hashes")[0].as_py())

    def asked(messages, kind):
        found = C._answer(pa.concat_tables(messages), C._elsewhere, kind)
        return mine.answered(found.filter(pc.equal(found.column("chunk"), 0))).tolist()
    assert asked(whole, np.uint64) == [False, False, True]
    assert asked(half, np.uint32) == [True, False, True]


def test_grades_of_half_hashes_are_the_same_in_all_chunks():
    sets = [np.array([(7 << 32) | 1, (8 << 32) | 3], np.uint64), np.array([(7 << 32) | 2, (9 << 32) | 5], np.uint64)]
    found = [C.Distinct.among(s, 1) for s in sets]
    counts = np.array([3, 1])
    graded = C._grade(pa.concat_tables([d.messages(i, counts, np.uint32, short=True) for i, d in enumerate(found)]))
    grades = [d.answered(graded.slice(i, 1), graded=True).tolist() for i, d in enumerate(found)]
    assert grades[0][0] == grades[1][0] > 1 and grades[0][1] == grades[1][1] == 0
