"""Documents that try to break operators, and plain versions of what they count."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, h string, size string, rank int, part string, _text string, n long, partner string, shard string, label string, _h long, _gone long, _all long"


def words(text):
    return WORD.findall(text or "")


def texts(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = [sentence(rng.randrange(1, 120)) for _ in range(n)]
    out = list(base)
    for b in base[: n // 4]:  # near copies, near copies of those, and exact copies
        w = b.split()
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
        out += [b, b.upper()]
    out += ["", " ", "\n\t ", "one", "One two", "a b c d", "a b c d e", "A b\tc\nd e", " ", "x y z w", "👩‍👩‍👧 née naïve été", "日本語のテキスト。 漢字かな", "word " * 4000, "y" * 30_000, "<|endoftext|> don't we'll it's 3.14 %%% (a)b,c;d", "<|ENDOFTEXT|> x.<|startoftext|>y<|endoftext|>", "line\n" * 50, "\x00 nul", "tab\tseparated\r\nlines\x0b\x0c end "]
    return out


def rows(seed=1, n=120):
    """Some null in every column, repeated ids, repeated rows, columns with clashing names."""
    out = []
    for i, t in enumerate(texts(n, seed)):
        out.append((i, t, ("en", "fr", None)[i % 3], None if i % 17 == 0 else f"s{'ab' if i % 2 else chr(0xE9)}{i % 4}", len(t), "x", 1, "h", "9", 3, "p", "t", 5, "q", "z", "l", 1, 2, 3))
    out.append((5, None, None, None, None, *[None] * 14))
    out.append((None, "no id here at all", "en", "sab1", None, *[None] * 14))
    out.append((7, out[7][1], *out[7][2:]))
    out.append((8, "another text under an id that is taken", "en", "sab1", 1, *[None] * 14))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def crc(data: bytes) -> int:
    return zlib.crc32(data)
