"""Comparing renders and texts with an oracle's, page by page, and totals of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.tables import rows

#: Pixels, and pixels in a million, by which a colour page may differ.
PIXELS, PER_MILLION = 2000, 100


def verify_renders(own: DataFrame, oracle: DataFrame) -> DataFrame:
    """status of every page of either side: match, tolerated (few colour pixels differ), mismatch, or which side lacks it."""
    side = lambda d, p: d.select("path", "page_no", *[F.col(c).alias(f"{p}_{c}") for c in ("width", "height", "format", "data")])
    both = side(own, "a").join(side(oracle, "b"), ["path", "page_no"], "full")

    def make(path, page_no, a_width, a_height, a_format, a_data, b_width, b_height, b_format, b_data):
        if a_data is None or b_data is None:
            status, n, mean, most = "both empty" if a_data is b_data else "missing here" if a_data is None else "missing in oracle", None, None, None
        elif (a_width, a_height, a_format) != (b_width, b_height, b_format):
            status, n, mean, most = "mismatch", None, None, None
        else:
            a, b = (np.frombuffer(x, np.uint8).astype(np.int16).reshape(a_width * a_height, -1) for x in (a_data, b_data))
            d = np.abs(a - b)
            n = int(d.any(1).sum())
            mean, most = (float(d.mean()), int(d.max())) if d.size else (0.0, 0)
            few = a_format == "RGB24" and n <= PIXELS and n * 1_000_000 <= len(d) * PER_MILLION
            status = "match" if not n else "tolerated" if few else "mismatch"
        yield path, page_no, status, n, mean, most

    return rows(both, "path string, page_no int, status string, diff_pixels long, mean_diff double, max_diff int", make)


def verify_totals(verified: DataFrame) -> DataFrame:
    """Counts of each status by document."""
    is_ = lambda *s: F.col("status").isin(*s)
    return verified.groupBy("path").agg(F.count("*").alias("pages"), F.count_if(is_("match", "tolerated")).alias("match"), F.count_if(is_("mismatch")).alias("mismatch"), F.count_if(is_("missing here", "missing in oracle")).alias("skip"), F.count_if(is_("both empty")).alias("both_empty"))


def failures(verified: DataFrame, n: int = 50) -> DataFrame:
    """The first mismatches by document and page; a top-n report."""
    return verified.where("status = 'mismatch'").orderBy("path", "page_no").limit(n)
