from __future__ import annotations

import pytest

from gristmill.operators import vocabulary


def test_pieces_beyond_the_limit_are_an_error(spark):
    counts = spark.createDataFrame([("ab", 3), ("abc", 2), ("bcd", 2)], "piece string, n long")
    with pytest.raises(ValueError, match="3 distinct pieces, more than 2"):
        vocabulary.train(counts, 256 + 2 + 2, 2, most_pieces=2)
    assert vocabulary.train(counts, 256 + 2 + 2, 2, most_pieces=3)[0] == [(b"a", b"b"), (b"b", b"c")]
