"""Documents with everything that can be odd about them."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, block string, id string, size string, tx string, node string, h string, part string, slot string, score string"
)
SYLLABLES = "ta ke mo ri sun val per dis con lu gra bel tor mi nes".split()


def words(random_, n):
    return ["".join(random_.choices(SYLLABLES, k=random_.randint(1, 3))) for _ in range(n)]


def edited(random_, own, rate):
    return [w if random_.random() > rate else "".join(random_.choices(SYLLABLES, k=2)) for w in own]


def texts(seed=5):
    r = random.Random(seed)
    base, passage = words(r, 120), words(r, 60)
    found = [" ".join(base)] * 4  # exact copies
    found += [" ".join(edited(r, base, rate)) for rate in (0.005, 0.01, 0.02, 0.05, 0.05, 0.2) for _ in range(3)]  # near ones
    for _ in range(8):  # a passage that many hold
        found.append(" ".join(words(r, r.randint(0, 40)) + passage + words(r, r.randint(0, 40))))
    found += [" ".join(words(r, r.randint(3, 200))) for _ in range(20)]
    found += [" ".join(base).upper(), " \t".join(base), "\n".join(base), "é à ü " * 30, "日本語の文。" * 40]
    found += ["", " \n\t ", "one", "two words", "one two three four", "One Two three four", ". , ! 12 34", "a b " * 100]
    found += [" ".join(words(r, 9000))]  # long
    found += [" ".join(passage * 3), "x" * 1200, "\U0001f600" * 150]
    return found


def rows(seed=5):
    all_ = texts(seed)
    found = []
    for i, t in enumerate(all_):
        lang = ("en", "fr", None)[i % 3]
        found.append((i * 7 % 101 + 1000 * (i // 101), t, lang, ("src1", "src2", "src1", None)[i % 4], len(t)))
    found.append((900, None, "en", "src1", None))
    found.append((901, None, None, None, None))
    found += [found[0], found[0], found[-1]]  # repeated rows
    return [(*f, "a", "b", "c", "d", "e", "f", "g", "h", "i", "j") for f in found]


def documents(spark, seed=5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def with_null_ids(spark):
    odd = [(None, t, "en", None, 1, *"abcdefghij") for t in ("null id " * 20, None, "null id " * 20, "plain")]
    return spark.createDataFrame(rows()[:30] + odd, SCHEMA).repartition(2)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
