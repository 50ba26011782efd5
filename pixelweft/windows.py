"""Moving windows by Catalyst: padding, box means, weighted sums and shifts, one axis at a time.

A separable window costs one exchange per axis: the pixels of a stretch of an image line meet in a window partition,
padded by mirrored or wrapped copies of border pixels only. A line longer than ``CHUNK`` pixels is cut into stretches
that hold copies of as many pixels of their neighbours as a window reaches, so no partition grows with the image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pad(df: DataFrame, axis: str, n: int, before: int, after: int, mode: str = "reflect") -> DataFrame:
    """Add copies of border pixels at coordinates -before .. n + after - 1 of an axis.

    reflect mirrors with the edge repeated, wrap is periodic; both work for windows wider than the image.
    """
    i = F.col(axis)
    rounds = max(before, after) // n + 2
    if mode == "wrap":
        at = [i + n * k for k in range(-rounds, rounds + 1)]
    else:
        at = [i + 2 * n * k for k in range(-rounds, rounds + 1)] + [-1 - i + 2 * n * k for k in range(-rounds, rounds + 1)]
    spots = F.filter(F.array(*at), lambda t: (t >= -before) & (t < n + after))
    # Most pixels have no copies.
    low, high = (after, before) if mode == "wrap" else (before, after)
    spots = F.when((i >= low) & (i < n - high), F.array(i)).otherwise(spots)
    return df.withColumn(axis, F.explode(spots))


CHUNK = 4096


def _line(keys: list[str], axis: str) -> W:
    other = "x" if axis == "y" else "y"
    return W.partitionBy(*keys, other).orderBy(axis)


def slide(df: DataFrame, keys: list[str], axis: str, n: int, before: int, after: int, columns: dict[str, callable], mode: str = "reflect", reach: int = 0) -> DataFrame:
    """Add columns computed by f(line window) on the padded axis, and drop the padding.

    ``reach`` is how far windows look beyond the padding.
    """
    padded = pad(df, axis, n, before, after, mode)
    if n > CHUNK:
        # A pixel is read by the windows of pixels from ``after`` before it to ``before`` after it.
        i = F.col(axis)
        chunk = F.floor(i / CHUNK)
        padded = padded.withColumn("_chunk", F.explode(F.sequence(F.floor((i - max(after, reach)) / CHUNK), F.floor((i + max(before, reach)) / CHUNK))))
        out = padded.withColumns({name: f(_line([*keys, "_chunk"], axis)) for name, f in columns.items()})
        return out.where((F.col("_chunk") == chunk) & (i >= 0) & (i < n)).drop("_chunk")
    line = _line(keys, axis)
    return padded.withColumns({name: f(line) for name, f in columns.items()}).where((F.col(axis) >= 0) & (F.col(axis) < n))


def box_mean(df: DataFrame, keys: list[str], cols: list[str], ny: int, nx: int, win: tuple[int, int] = (7, 7), mode: str = "reflect") -> DataFrame:
    """Replace cols by their means over a (rows, columns) window; other columns stay.

    An even window of s covers i - s // 2 .. i + s - s // 2 - 1.
    """
    for axis, n, s in (("y", ny, win[0]), ("x", nx, win[1])):
        if s > 1:
            a, b = s // 2, s - s // 2 - 1
            mean = {c: (lambda line, c=c, a=a, b=b: F.avg(c).over(line.rowsBetween(-a, b))) for c in cols}
            df = slide(df, keys, axis, n, a, b, mean, mode)
    return df


def weighted(df: DataFrame, keys: list[str], axis: str, cols: list[str], n: int, weights: list[float], mode: str = "reflect", centre: int | None = None) -> DataFrame:
    """Replace cols by the sum of w[k] * v[i + k - centre] along an axis."""
    c0 = len(weights) // 2 if centre is None else centre

    def total(line, c):
        terms = [F.lit(float(w)) * F.lead(c, k - c0).over(line) for k, w in enumerate(weights) if w]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return slide(df, keys, axis, n, c0, len(weights) - 1 - c0, {c: (lambda line, c=c: total(line, c)) for c in cols}, mode)


def gauss_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gauss(df: DataFrame, keys: list[str], cols: list[str], ny: int, nx: int, sigma: tuple[float, float]) -> DataFrame:
    for axis, n, s in (("y", ny, sigma[0]), ("x", nx, sigma[1])):
        if s > 0:
            df = weighted(df, keys, axis, cols, n, gauss_weights(s))
    return df


def kernel2d(df: DataFrame, keys: list[str], cols: list[str], ny: int, nx: int, kernel: list[list[float]]) -> DataFrame:
    """Convolution with a small 2-D kernel (flipped), mirrored borders: one pass per axis."""
    flipped = [row[::-1] for row in kernel[::-1]]
    h, w = len(flipped), len(flipped[0])
    # An even size is centred as a convolution is: the flip moves the origin by one.
    cy, cx = h - 1 - h // 2, w - 1 - w // 2
    parts = {}
    for c in cols:
        for k, row in enumerate(flipped):
            def along(line, c=c, row=row):
                out = F.lit(0.0)
                for j, v in enumerate(row):
                    if v:
                        out = out + F.lit(float(v)) * F.lead(c, j - cx).over(line)
                return out

            parts[f"_{c}_{k}"] = along
    df = slide(df, keys, "x", nx, cx, w - 1 - cx, parts)
    sums = {}
    for c in cols:
        def down(line, c=c):
            out = F.lit(0.0)
            for k in range(h):
                out = out + F.lead(f"_{c}_{k}", k - cy).over(line)
            return out

        sums[c] = down
    return slide(df, keys, "y", ny, cy, h - 1 - cy, sums).drop(*parts)


def shifted(df: DataFrame, keys: list[str], ny: int, nx: int, shifts: dict[str, tuple[str, int, int]], mode: str = "wrap") -> DataFrame:
    """Add columns name = value of (column, dy, dx) at (y + dy, x + dx)."""
    reach = max((abs(dx) for _, _, dx in shifts.values()), default=0)
    across = {f"_s_{c}_{dx}": (lambda line, c=c, dx=dx: F.lead(c, dx).over(line)) for c, _, dx in shifts.values()}
    df = slide(df, keys, "x", nx, reach, reach, across, mode)
    tall = max((abs(dy) for _, dy, _ in shifts.values()), default=0)
    down = {name: (lambda line, c=c, dy=dy, dx=dx: F.lead(f"_s_{c}_{dx}", dy).over(line)) for name, (c, dy, dx) in shifts.items()}
    return slide(df, keys, "y", ny, tall, tall, down, mode).drop(*across)


def safe(num: Column, den: Column) -> Column:
    """num / den, 0 where that isn't finite."""
    return F.coalesce(F.when(den != 0, num / den), F.lit(0.0))
