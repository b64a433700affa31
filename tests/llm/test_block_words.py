"""All words of a block reach its features."""

import numpy as np

from siftline.llm import html_blocks


def test_later_words_count():
    head = "word " * 64
    a, b = html_blocks.features([(head + "alpha " * 40, 0, 0), (head + "gamma " * 40, 0, 0)], html_blocks.Paths())
    words = slice(html_blocks.PATH_DIM, html_blocks.PATH_DIM + html_blocks.WORD_DIM)
    assert not np.array_equal(a[words], b[words])
