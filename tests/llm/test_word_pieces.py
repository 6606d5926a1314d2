"""Words that are no letters alone are cut to the pieces of the file's pattern, and each piece goes to the library's model once."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codelode.llm.encoding import Encoder


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_words_give_the_librarys_ids(file):
    r = random.Random(7)
    letters = "abcxyzéßÿÀÖ'''..,,!!##__--0123456789@|<>()\"~ \t\n\r   sStTmMdDlLvVeErR"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    library, own = Tokenizer.from_file(public_tokenizers.path(file)), Encoder(public_tokenizers.path(file), "ids")
    got = [b"".join(x) for at in range(0, len(texts), 100) for x in own.pieces(texts[at : at + 100])]
    assert got == [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_are_met_once():
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"), "ids")
    met, tokenize, whole = [], own.tokenize, own.ids
    own.tokenize = lambda piece: met.append(piece) or tokenize(piece)
    own.ids = lambda texts: met.extend(("whole", t) for t in texts if t not in (",", ".")) or whole(texts)
    own.pieces(["stop!!! don't größe### stop, stop!!!"])
    own.pieces(["Stop### don###"])
    assert sorted(map(str, met)) == sorted(["stop", "!!!", "don", "'t", "grÃ¶ÃŁe", "###"])
