"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from lumenary.llm.bpe import op2_bpe_lexicon
from lumenary.llm.language import op8_language_bayes
from lumenary.llm.media import op1_media_jpeg
from lumenary.llm.packing import op6_best_fit
from lumenary.llm.phrases import OP13_SQL, op13_phrase_graph
from lumenary.llm.pieces import op12_piece_prefixes
from lumenary.llm.repeats import op11_periodic_runs
from lumenary.llm.rules import op4_isolation_rules
from lumenary.llm.secrets import op5_credential_links
from lumenary.llm.simhash import op7_simhash_covering
from lumenary.llm.substrings import op3_suffix_dedup
from lumenary.llm.tokencount import op9_token_counts
from lumenary.llm.toxicity import op10_toxicity_channel

_ALL = (
    op1_media_jpeg, op2_bpe_lexicon, op3_suffix_dedup, op4_isolation_rules, op5_credential_links,
    op6_best_fit, op7_simhash_covering, op8_language_bayes, op9_token_counts, op10_toxicity_channel,
    op11_periodic_runs, op12_piece_prefixes, op13_phrase_graph,
)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}
ORACLE = {"op13_phrase_graph": OP13_SQL}
