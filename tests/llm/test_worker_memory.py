"""A Python worker that serves one operator after another holds the tables of the last one only."""

import gc
import weakref

import pyarrow as pa

from retailforge.llm import bpe, common, langid
from retailforge.llm.tokencount import vocabulary_path


def test_a_process_holds_one_vocabulary():
    first = weakref.ref(langid.pieces(langid.VOCABULARY))
    assert langid.pieces(langid.VOCABULARY) is first()
    path = vocabulary_path("byte_bpe_50k.json")
    encoder = bpe.encoder(path, counts=False)
    gc.collect()
    assert first() is None  # the language pieces went when the encoder came
    assert bpe.encoder(path, counts=False) is encoder


def test_tidy_functions_pass_all_batches_on():
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], names=["x"]) for i in range(3)]
    assert list(common.tidy(lambda it: (b for b in it))(iter(batches))) == batches


def test_blocks_of_texts_do_not_change_the_pieces():
    encoder = bpe.encoder(vocabulary_path("byte_bpe_50k.json"), counts=False)
    texts = pa.array(["one two", None, "three  four's", "", "x" * 100, "five 123"])
    whole = [[p.hashes(p.starts, p.ends).tolist() for p in encoder.blocks(texts, size)] for size in (1 << 20, 16)]
    assert sum(whole[0], []) == sum(whole[1], [])
