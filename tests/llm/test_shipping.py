"""Functions that run in tasks must load where the package is not installed."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from econspark.llm import conversation_repair, license_scan, maxent_lm, near_dedup, packing, piece_codec, secret_scan, tokeniser_quality, topk_search, whitening

NONE = (np.zeros(0, np.uint64), np.zeros(0))
INDEX = license_scan.Index(license_scan.BASE, {w: 1 for t in license_scan.BASE for w in t.words}, 0.8, 32)


@pytest.mark.parametrize(
    "fn",
    [
        packing._pack_partition(packing.word_encoder("x"), ("words", "x"), 1, 2048, 16, True), packing._merge_group(2048, True), tokeniser_quality._task("x", "y", tokeniser_quality.BANDS, 0, 1, "q"),
        near_dedup._sign(NONE), near_dedup._agreeing, near_dedup._block_links(NONE, 0.8), near_dedup._verify(NONE, 0.8), INDEX.scan, secret_scan.find_secrets, piece_codec.Codec,
        topk_search._make_blocks(3), topk_search._query_rows(3), topk_search._query_blocks, topk_search._histograms(3, 1), topk_search._narrow(1), topk_search._emit(3),
        conversation_repair._make_chunks(None), conversation_repair._meet, conversation_repair._rebuild, conversation_repair._streamed(None),
        maxent_lm._make_chunks(None), maxent_lm._dictionaries, maxent_lm._code(None, None), maxent_lm._gradients(None, 0), maxent_lm._step({}), maxent_lm._scored(None, None, None),
        whitening._sums(0), whitening._residues([[1]]), whitening._together, whitening._components([[1]], [0, 1], 1), whitening._whitened_rows(None, "w"), whitening._whitened_sums(None),
    ],
    ids=lambda f: f.__qualname__,
)
def test_loads_without_the_package(fn, tmp_path):
    data = cloudpickle.dumps(fn)
    code = "import pickle, sys; sys.path[:] = [p for p in sys.path if p and 'repo' not in p]; pickle.load(sys.stdin.buffer); assert not any(m.startswith('econspark') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd=tmp_path, timeout=60)
    assert done.returncode == 0, done.stderr.decode()[-500:]
