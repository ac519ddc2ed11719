import random
from functools import cache

import public_tokenizers
from tokenizers import Tokenizer


@cache
def _tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def library_ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids


def passages(seed: int, n: int, size: int) -> list[str]:
    rnd = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "ne", "lo", "sa", "mi", "po", "du", "ke", "va"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    return [" ".join(word() for _ in range(size)) for _ in range(n)]


def lengths():
    rnd = random.Random(4)
    return [(i, " ".join(rnd.choice(["the", "of", "and", "to"]) for _ in range(int(rnd.lognormvariate(6, 1))))) for i in range(400)]
