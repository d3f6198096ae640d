import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("block", T.StringType()), T.StructField("n_chars", T.LongType())]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=3, n=40):
    """Random prose, near copies, exact copies, shared passages, and odd cases."""
    r = random.Random(seed)
    parts = "an re th on er ing ed ti sh où été ñó ß 中文".split()
    vocabulary = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(400)]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k)).capitalize() + "."
    out = ["\n".join(prose(r.randint(3, 60)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    base = prose(150)
    for _ in range(6):
        w = base.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    passage = prose(70)
    out += [prose(40) + "\n" + passage + "\n" + prose(30) for _ in range(4)]
    out += [out[0], out[0], None, "", " \n\t ", "one", "one two three", "For " * 600, "x" * 700, "a\u001fb <|endoftext|> c", "É́ ΑΣ 's <|startoftext|>", "  double  spaces \n here", prose(9000)]
    return out


def frame(spark, values, repeat=True):
    rows = [(i * 3, t, "en", "x", None if t is None else len(t)) for i, t in enumerate(values)]
    if repeat:
        rows += [rows[1], (None, "null id " * 60, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
