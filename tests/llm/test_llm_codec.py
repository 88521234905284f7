"""The codec's glued ids and checks on whole texts."""

import sentencepiece

from clausemesh.llm import sentencepiece_codec


def test_a_last_single_space_is_a_token():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    original = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = ["a ", "a b ", " a ", "a  b ", "a  ", " ", "", "a b"]
    for _ in range(2):
        found = codec.run(texts)
        assert [i.tolist() for i, _, _ in found] == original.encode(texts)
        assert all(back and same for _, back, same in found)


def test_checks_look_at_the_glued_ids():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    codec.run(["one two three"])
    codec.known["two"] = codec.known["three"]
    assert [(back, same) for _, back, same in codec.run(["one two three", "one three"])] == [(False, False), (True, True)]


def test_words_at_hand_stay_known_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "SEEN_WORDS", 6)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    learned, learn = [], codec._learn
    monkeypatch.setattr(codec, "_learn", lambda new: (learned.append(set(new)), learn(new)))
    codec.run(["one two three", "four five six"])
    texts = ["one two seven ", "seven eight  two"]
    found = codec.run(texts)
    assert learned[1] == {"seven", "eight", " two"} and {"one", "two"} <= codec.known.keys() and "four" not in codec.known
    original = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert [i.tolist() for i, _, _ in found] == original.encode(texts) and all(back and same for _, back, same in found)


def test_a_text_that_its_ids_do_not_give_is_found_among_others():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    good = [i for i, _, _ in codec.run(["one two", "", "three four"])]
    assert codec._gives(good, ["one two", "", "three four"]) == [True, True, True]
    assert codec._gives(good, ["one two t", "", "hree four"]) == [False, True, False]
    assert codec._gives([], []) == []
