"""What the byte-level codec spends on common words, and that the short way gives the library's ids."""

from itertools import product

import public_tokenizers
import regex
import tokenizers

from porelake.llm.bpe_codec import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_and_punctuation_need_no_pattern():
    """A word is encoded once, whatever punctuation follows it; the pattern sees the text's first word only."""
    bpe = ByteBpe(PATH)
    encoded, split = [], []
    whole = bpe._encode_pretoken

    def counted(piece):
        encoded.append(piece)
        return whole(piece)

    class Split:
        def findall(self, text):
            split.append(text)
            return regex.findall(bpe_split, text)

    bpe_split, bpe.split = bpe.split, Split()
    bpe._encode_pretoken = bpe.pretokens.make = counted
    bpe.encode("so zorble zorble, zorble. (zorble) élanx élanx, zorble.")
    assert split == ["so", " (zorble)"]
    assert sorted(encoded) == sorted(["so", " zorble", ",", ".", " (", "zorble", ")", " élanx"])


def test_short_way_equals_the_library():
    t = tokenizers.Tokenizer.from_file(PATH)
    bpe = ByteBpe(PATH, cache_size=50)
    cores = ["ab", "é", "ſtª", "µº", "中文", "ʰa", "ɐz", "ab1", "12", "٣", "I'll", "don't", "'s", "́", "x\ny"]
    tails = ["", "'", "'s", ",", "...", "_", "'ll.", " .", "\n", "\t,", "!a", "’", "$$$"]
    texts = [f"{c}{p} {d}{q}{p}" for c, d in product(cores, cores) for p, q in product(tails, tails[:4])]
    assert all(bpe.encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)
