"""All corpus queries; importing the modules registers them."""

from lexigrain.llm import (  # noqa: F401
    byte_bpe,
    html_template,
    langid,
    lexical_search,
    line_rules,
    mixing,
    packing,
    prefix_trie,
    quality,
    records,
    simhash,
    url_filter,
    vector_graph,
)
from lexigrain.llm.common import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
