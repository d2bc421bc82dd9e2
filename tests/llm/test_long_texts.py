"""What one very long text takes beside its own bytes, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import resource
import numpy as np, pyarrow as pa, public_tokenizers
from regolith.llm import bpe, decontaminate, linear, near_dedup, secrets, statistics, textscan, token_files, toxicity, transducer
base = "The house of the thing and then some other words, 12 of them; könnte sein. "
text = pa.array([base * (20_000_000 // len(base.encode()))])
small = pa.array(["a b c"])
def op1(texts):
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids, offsets = bpe._encoder(tokens).encode(texts)
    data, _ = bpe.merger(tokens).decode(ids, offsets)
    bpe.digests(ids, offsets)
    assert data.tobytes() == (texts[0].as_py() or "").encode()
def op8(texts):
    token_files.encode_texts(open(public_tokenizers.path("byte_bpe_50k.json")).read(), texts, True)
def op7(texts):
    toxicity.Voters(toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0), *toxicity.fixed_words())).look(texts)
def op11(texts):
    own = transducer.speller(open(public_tokenizers.path("word_bpe_49k.json")).read())
    transducer.Encoder(transducer.Lexicon(transducer.Lexicon.build([b"the"], [[518]])), own).encode(texts)
work = {
    "op11": op11, "op1": op1, "op2": lambda t: list(near_dedup.shingle_sets(t, 2)), "op4": statistics.count, "op5": decontaminate.word_hashes, "op6": lambda t: secrets.find(t[0].as_py()),
    "op7": op7, "op8": op8, "op9": lambda t: list(linear.ngram_rows(*textscan.buffer_of(t), 11)),
}["%s"]
work(small)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
work(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / 20_000_000)
"""


@pytest.mark.parametrize(("name", "most"), [("op1", 12), ("op2", 14), ("op4", 24), ("op5", 14), ("op6", 8), ("op7", 12), ("op8", 12), ("op9", 8), ("op11", 16)])
def test_memory_beside_a_text_of_20_mb(name, most):
    out = subprocess.run([sys.executable, "-c", SCRIPT % name], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < most, out.stdout
