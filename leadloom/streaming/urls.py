"""Each URL once, over an unbounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_sight(stream: DataFrame, row_id: str, url: str = "url", spread: int = 16,
                watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row of every URL.

    Two keyed de-duplications: the first on (URL, spread bucket), so that the
    copies of one very frequent URL are dropped by many tasks, the second on
    the URL, which then sees at most ``spread`` rows of it. With a watermark
    (time column, delay) state is dropped once the delay has passed.
    """
    keyed = stream.withColumns({
        "url_hash": F.sha2(url, 256),
        "__bucket": F.pmod(F.xxhash64(row_id), F.lit(spread)),
    })
    if watermark:
        keyed = keyed.withWatermark(*watermark)
        return (keyed.dropDuplicatesWithinWatermark(["url_hash", "__bucket"])
                .dropDuplicatesWithinWatermark(["url_hash"]).drop("__bucket"))
    return keyed.dropDuplicates(["url_hash", "__bucket"]).dropDuplicates(["url_hash"]).drop("__bucket")
