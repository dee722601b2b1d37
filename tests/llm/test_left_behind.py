"""Queries leave the table of their result behind and nothing else."""

from __future__ import annotations

from pathlib import Path

import pytest

from fieldsonar.llm.common import shared_dir
from fieldsonar.llm.queries import QUERIES
from tests.llm.util import DATA


def folders(spark):
    top = Path(shared_dir(spark).removeprefix("file:").replace("///", "/"))
    return {p.name for p in top.iterdir()} if top.exists() else set()


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op5_latent_decontamination", "op7_sentence_spans", "op8_best_fit_packing", "op10_secret_ledger", "op12_warc_writer", "op13_chat_repair"])
def test_nothing_is_left_behind(spark, name):
    before = folders(spark)
    got = QUERIES[name](spark, str(DATA))
    left = folders(spark) - before
    assert len(left) <= 1 and all(x.startswith(name) for x in left)
    assert got.count() > 0
