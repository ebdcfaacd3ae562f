"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, score double, row string, mix string"
PAGES = "page_id long, url string, html string, host string, classes string, text string"
BENCHMARK = "item_id long, text string, doc_id long, score double, rank int, item long"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score double, rank int"

VOCABULARY = {
    "en": "the of and shing thion nder erly over this whan ther hand oning which".split(),
    "de": "der die und schau geber licht keit zwisch über pferd nicht aucht eine".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(VOCABULARY[lang], k=rng.choice((1, 1, 2)))) for _ in range(n))


def document_rows(seed: int = 5) -> list[tuple]:
    """Plain texts, near copies, shared passages, and: null, empty, blank, one word, signs only, very long, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for n in range(40):
        texts.append(sentence(rng, "de" if n % 3 == 0 else "en", rng.randint(5, 120)))
    base = sentence(rng, "en", 90)
    for n in range(12):  # near copies of one text
        words = base.split()
        words[rng.randrange(len(words))] = f"changed{n}"
        texts.append(" ".join(words))
    passage = sentence(rng, "en", 70)
    for _ in range(4):
        texts.append(f"{sentence(rng, 'en', 30)}\n{passage} {sentence(rng, 'en', 25)}")
    texts += ["ab " * 400, sentence(rng, "de", 20_000), base, base, "Tab\tand hard  space\x1cÉcole ünï 中文 \U0001f600 it's",
              "word", "Word", "### 12 %%%", "   \n", "", None, None]
    rows = [(n, t, None if n % 11 == 5 else ("de" if n % 3 == 0 and n < 40 or n == 57 else "en"), None if n % 13 == 4 else f"src{n % 4}",
             len(t or ""), 7, n % 3, 0.5, "row", "mix") for n, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], rows[-1]]


def tables(spark, folder: str, documents=None, pages=None, embeddings=None, benchmark=None) -> str:
    for name, schema, rows in (("documents", DOCUMENTS, documents), ("pages", PAGES, pages), ("embeddings", EMBEDDINGS, embeddings),
                               ("benchmark", BENCHMARK, benchmark)):
        if rows is not None:
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder
