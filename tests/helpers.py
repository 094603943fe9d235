"""Small helpers of the tests."""

from pyspark.sql import functions as F

RAW = (
    "source string, title string, url string, author string, published_at string, "
    "scraped_at string, content string, summary string, category string, tags array<string>"
)


def column(spark, values, fn, dtype="string"):
    """Apply a column function to Python values and return the results in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {dtype}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def raw(spark, rows):
    """Raw articles from dicts with any of the raw fields; ``_ord`` is the position."""
    names = [f.split()[0] for f in RAW.split(", ")]
    data = [tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, RAW + ", _ord bigint")


def article(**fields):
    base = {"source": "test", "title": "A title", "url": "https://example.com/a", "tags": []}
    return base | fields
