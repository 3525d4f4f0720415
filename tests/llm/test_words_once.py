"""Plain words go to the tokenizer's model alone."""

import types

import public_tokenizers
import pyarrow as pa
from ephemera.llm import store


class Seen:
    def __init__(self, tokenizer):
        self.tokenizer, self.parts = tokenizer, []

    def encode_batch_fast(self, parts, **options):
        self.parts += parts
        return self.tokenizer.encode_batch_fast(parts, **options)


def test_latin_words_are_not_normalised_one_by_one():
    own = store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    library, own.tokenizer = own.tokenizer, Seen(own.tokenizer)
    letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    texts = ["Élan, naïve straße. ÀÉÎ ÿ! über", " ".join(letters), " ".join(f"a{c}b{c}" for c in letters)]
    assert [ids.tolist() for ids in own.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(own.tokenizer.parts) <= set(store._CLOSING)


def test_parts_beyond_the_remembered_ones(monkeypatch):
    monkeypatch.setattr(store, "REMEMBERED", 3)
    monkeypatch.setattr(store, "CORES", 3)
    own = store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("one two three four", "five. six é two", "x-1 five. six, Ö one"):
        assert own.ids([t, t])[1].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_word_of_a_batch_is_encoded_once_and_looked_up_once(monkeypatch):
    """Words that are not remembered come to the model once in some megabytes of texts, not once in each."""
    monkeypatch.setattr(store, "REMEMBERED", 0)
    monkeypatch.setattr(store, "CORES", 0)
    own = store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    model, words = own.model, []
    own.model = types.SimpleNamespace(tokenize=lambda w: words.append(w) or model.tokenize(w))
    monkeypatch.setattr(store, "encoder", lambda path: own)
    monkeypatch.setattr(store, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    texts = ["Oak, oak. elm\tOAK!\n" * 20_000] * 4 + [None, ""] + ["ash"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(store._chunks("", iter([rows])))
    assert sorted(words) == ["ash", "elm", "oak"]
    n = pa.TableGroupBy(out, "doc_id").aggregate([("n", "sum")]).sort_by("doc_id")["n_sum"].to_pylist()
    assert n == [len(own.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
