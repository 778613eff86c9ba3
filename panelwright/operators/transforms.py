"""Per-series transforms of a panel (sample_id, var_id, x), as array expressions of one row.

Every transform is skipped for validation and test data and otherwise gated by one uniform draw a batch
(``batch_id`` where the panel has it, else one draw for all): it is applied when the draw is at most ``p``.
Draws are functions of the seed and of keys at the grain of each transform (batch, sample, series, element),
so results don't hang on partitioning and every engine can repeat them. A few transforms need all variables
of a sample at once; they group by sample and say so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays as A
from panelwright.functions import rand as R

REGISTRY: dict[str, Callable] = {}
SAMPLE, SERIES = ("sample_id",), ("sample_id", "var_id")


class Draw:
    """Uniform and normal draws of one transform; batch-level ones carry the batch."""

    def __init__(self, df: DataFrame, seed: int, name: str):
        self.seed, self.name, self.batch = seed, name, ("batch_id",) if "batch_id" in df.columns else ()

    def u(self, what: str, *keys) -> Column:
        return R.uniform(self.seed, f"{self.name}/{what}", *(keys or self.batch))

    def z(self, what: str, *keys) -> Column:
        return R.normal(self.seed, f"{self.name}/{what}", *(keys or self.batch))

    def between(self, lo: float, hi: float, what: str, *keys) -> Column:
        return lo + (hi - lo) * self.u(what, *keys)


def transform(f: Callable) -> Callable:
    """Make an operator of ``f(x, draw, **settings) -> new x``."""
    name = f.__name__

    def op(df: DataFrame, *, p: float = 0.5, seed: int = 42, split: str = "train", **settings) -> DataFrame:
        if split != "train":
            return df
        d = Draw(df, seed, name)
        new = A.let(F.col("x"), lambda x: f(x, d, **settings))
        return df.withColumn("x", new if p >= 1 else F.when(d.u("gate") <= p, new).otherwise(F.col("x")))

    op.__name__, op.__doc__ = name, f.__doc__
    REGISTRY[name] = op
    return op


def _len(x: Column) -> Column:
    return F.size(x)


def _int(c: Column) -> Column:
    return c.cast("int")


def _knots(x: Column, values: list[Column]) -> Column:
    """Straight lines through ``values`` at equal distances over the length of ``x``."""
    return A.let(F.array(*values), lambda k: F.transform(x, lambda v, t: A.lookup(k, t / F.greatest(_len(x) - 1, F.lit(1)) * (len(values) - 1))))


# value transforms


@transform
def gaussian_noise(x, d, std=0.1):
    """Adds normal noise to each element."""
    return F.transform(x, lambda v, t: v + std * d.z("noise", *SERIES, t))


@transform
def uniform_noise(x, d, std=0.1):
    """Adds uniform noise between -std and std to each element."""
    return F.transform(x, lambda v, t: v + std * (2 * d.u("noise", *SERIES, t) - 1))


@transform
def mag_add_noise(x, d, magnitude=0.1):
    """Adds normal noise in proportion to the value's size."""
    return F.transform(x, lambda v, t: v + d.z("noise", *SERIES, t) * magnitude * F.abs(v))


@transform
def mag_mul_noise(x, d, magnitude=0.1):
    """Multiplies each element by 1 + z m."""
    return F.transform(x, lambda v, t: v * (1 + d.z("noise", *SERIES, t) * magnitude))


@transform
def mag_scale(x, d, factor=1.2):
    """One factor between 1 / f and f."""
    return A.let(d.between(1 / factor, factor, "scale"), lambda s: F.transform(x, lambda v: v * s))


@transform
def mag_scale_per_var(x, d, lo=0.8, hi=1.2):
    """A factor of its own for each series."""
    return A.let(d.between(lo, hi, "scale", *SERIES), lambda s: F.transform(x, lambda v: v * s))


@transform
def mag_warp(x, d, sigma=0.2, n_knots=4):
    """Multiplies by lines through normal draws around 1."""
    return F.zip_with(x, _knots(x, [1 + sigma * d.z(f"knot{i}") for i in range(n_knots)]), lambda v, w: v * w)


@transform
def vertical_flip(x, d):
    """Negates a sample with probability one half."""
    return F.when(d.u("coin", *SAMPLE) < 0.5, F.transform(x, lambda v: -v)).otherwise(x)


@transform
def flip_value(x, d):
    """Negates."""
    return F.transform(x, lambda v: -v)


@transform
def random_trend(x, d, max_trend=0.1, max_quadratic=0.0):
    """Adds a t / L + b (t / L)^2 with slopes drawn for each series."""
    a, b = d.between(-max_trend, max_trend, "a", *SERIES), d.between(-max_quadratic, max_quadratic, "b", *SERIES)
    return A.let(F.struct(a.alias("a"), b.alias("b")), lambda k: F.transform(x, lambda v, t: v + k["a"] * (t / _len(x)) + k["b"] * (t / _len(x)) * (t / _len(x))))


@transform
def random_freq_noise(x, d, magnitude=0.1, band="high"):
    """Noise in proportion to the series' deviation: ``high`` noise less its local mean, ``mid`` three sinusoids, ``low`` a centred random walk, else uniform."""
    m = A.total(x) / _len(x)
    std = A.let(m, lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / _len(x)))

    def noise(raw):
        if band == "high":
            return F.zip_with(raw, A.running_mean(raw, 5), lambda a, b: a - b)
        if band == "mid":
            waves = F.array(*[F.struct((2 * F.pi() * (3 + 4 * d.u(f"freq{i}", *SERIES))).alias("f"), (2 * F.pi() * d.u(f"phase{i}", *SERIES)).alias("p")) for i in range(3)])
            return A.let(waves, lambda w: F.transform(x, lambda v, t: F.aggregate(w, F.lit(0.0), lambda a, k: a + F.sin(k["f"] * t / _len(x) + k["p"])) / 3))
        if band == "low":
            walk = F.transform(x, lambda v, t: A.total(F.slice(raw, F.lit(1), t + 1)))
            return A.let(walk, lambda w: A.let(A.total(w) / _len(x), lambda c: F.transform(w, lambda v: (v - c) / F.sqrt(_len(x).cast("double")))))
        return raw

    raw = F.transform(x, lambda v, t: 2 * d.u("noise", *SERIES, t) - 1)
    return A.let(std, lambda s: F.zip_with(x, A.let(raw, noise), lambda v, e: v + e * magnitude * s))


# masks


@transform
def cutout(x, d, max_cut_ratio=0.2, fill=0.0):
    """One run of max(1, int(L r u)) steps becomes ``fill``."""
    n = F.greatest(_int(_len(x) * max_cut_ratio * d.u("length")), F.lit(1))
    return _masked(x, _int(d.u("start") * (_len(x) - n + 1)), n, fill)


@transform
def time_mask(x, d, time_mask_param=100, num_masks=1, mask_value=0.0):
    """Runs of steps masked in all variables of a sample."""
    for i in range(num_masks):
        n = _int(d.u(f"length{i}", *SAMPLE) * F.least(F.lit(time_mask_param), _len(x)))
        s = _int(d.u(f"start{i}", *SAMPLE) * (_len(x) - n + 1))
        x = _masked(x, s, n, mask_value)
    return x


def _masked(x: Column, s: Column, n: Column, value: float) -> Column:
    return A.let(F.struct(s.alias("s"), (s + n).alias("e")), lambda k: F.transform(x, lambda v, t: F.when((t >= k["s"]) & (t < k["e"]), value).otherwise(v)))


@transform
def frequency_mask(x, d, freq_mask_param=27, num_masks=1, mask_value=0.0, n_vars=1):
    """Runs of variables masked in each sample; variables stand for frequencies."""
    out = x
    for i in range(num_masks):
        n = _int(d.u(f"length{i}", *SAMPLE) * min(freq_mask_param, n_vars))
        s = _int(d.u(f"start{i}", *SAMPLE) * (n_vars - n + 1))
        hit = (F.col("var_id") >= s) & (F.col("var_id") < s + n)
        out = F.when(hit, F.transform(x, lambda v: F.lit(mask_value))).otherwise(out)
    return out


@transform
def mask_out(x, d, max_mask_ratio=0.2, fill=0.0):
    """max(1, round(L u)) random steps filled in all variables of a sample, the ratio drawn for the batch."""
    n = F.greatest(F.round(_len(x) * max_mask_ratio * d.u("ratio")), F.lit(1)).cast("int")
    draws = F.transform(x, lambda v, t: d.u("step", *SAMPLE, t))
    limit = lambda u: F.get(F.array_sort(u), n - 1)
    return A.let(draws, lambda u: A.let(limit(u), lambda k: F.zip_with(x, u, lambda v, w: F.when(w <= k, fill).otherwise(v))))


@transform
def var_out(x, d, max_drop_ratio=0.2, fill=0.0, n_vars=1):
    """round(V u) random variables of a sample filled, one at least left."""
    n = F.least(F.round(n_vars * max_drop_ratio * d.u("ratio", *SAMPLE)), F.lit(n_vars - 1)).cast("int")
    order = F.array_sort(F.array(*[d.u("var", *SAMPLE, F.lit(v)) for v in range(n_vars)]))
    hit = (n > 0) & (d.u("var", *SAMPLE, "var_id") <= F.get(order, F.greatest(n - 1, F.lit(0))))
    return F.when(hit, F.transform(x, lambda v: F.lit(fill))).otherwise(x)


@transform
def time_step_out(x, d, drop_prob=0.1, fill=None):
    """Steps dropped in all variables of a sample: ``fill``, or the step before as it was."""
    def value(v, t):
        instead = F.lit(fill) if fill is not None else F.coalesce(F.get(x, F.greatest(t - 1, F.lit(0))), v)
        return F.when(d.u("step", *SAMPLE, t) < drop_prob, instead).otherwise(v)

    return F.transform(x, value)


@transform
def input_dropout(x, d, drop_prob=0.1, fill=0.0):
    """Single cells become ``fill``."""
    return F.transform(x, lambda v, t: F.when(d.u("cell", *SERIES, t) < drop_prob, fill).otherwise(v))


@transform
def self_dropout(x, d, drop_prob=0.1, use_prev_value=True):
    """Cells after the first become the last kept value, or 0."""
    if not use_prev_value:
        return F.transform(x, lambda v, t: F.when((t > 0) & (d.u("cell", *SERIES, t) < drop_prob), 0.0).otherwise(v))
    kept = F.filter(A.steps(_len(x)), lambda t: (t == 0) | (d.u("cell", *SERIES, t) >= drop_prob))
    return A.let(kept, lambda kept: F.transform(x, lambda v, t: F.get(x, F.array_max(F.filter(kept, lambda k: k <= t)))))


# order of steps


@transform
def flip_time(x, d):
    """Reverses time."""
    return F.reverse(x)


@transform
def ts_horizontal_flip(x, d):
    """Reverses a sample with probability one half."""
    return F.when(d.u("coin", *SAMPLE) < 0.5, F.reverse(x)).otherwise(x)


def _offset(x: Column, u: Column, ratio: float) -> Column:
    k = F.round(_len(x) * ratio)
    return _int(F.floor(u * (2 * k + 1)) - k)


@transform
def rotation(x, d, max_rotation=0.5):
    """Circular shift by up to round(L r) either way, the same for the batch."""
    return A.roll(x, _offset(x, d.u("k"), max_rotation))


@transform
def ts_random_shift(x, d, max_shift_frac=0.5):
    """Circular shift of each sample."""
    return A.roll(x, _offset(x, d.u("k", *SAMPLE), max_shift_frac))


@transform
def random_shift(x, d, max_shift=0.2, direction="both", fill=0.0):
    """Shift with ``fill``: ``both``, ``left`` or ``right``."""
    k = _offset(x, d.u("k"), max_shift)
    return A.shift(x, k if direction == "both" else -F.abs(k) if direction == "left" else F.abs(k), fill)


@transform
def translate_x(x, d, max_translate=0.2, fill=0.0, wrap=False):
    """Shift by up to int(L r) with ``fill`` or around."""
    k = F.floor(_len(x) * max_translate)
    k = _int(F.floor(d.u("k") * (2 * k + 1)) - k)
    return A.roll(x, k) if wrap else A.shift(x, k, fill)


def _segments(x: Column, n: int) -> Column:
    """Slices of L / n steps, the last with the rest."""
    size = F.greatest(_int(F.floor(_len(x) / n)), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(x, i * size + 1, F.when(i == n - 1, F.greatest(_len(x) - i * size, F.lit(0))).otherwise(size)))


@transform
def permutation(x, d, n_segments=5):
    """Segments in a random order."""
    parts = _segments(x, n_segments)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_segments - 1)), lambda i: F.struct(d.u("segment", i).alias("u"), i.alias("i"))))
    return F.when(_len(x) >= n_segments, A.let(parts, lambda p: F.flatten(F.transform(order, lambda o: F.get(p, o["i"]))))).otherwise(x)


@transform
def shuffle_steps(x, d, n_segments=5):
    """Steps shuffled inside each segment, alike in all variables of a sample."""
    size = F.greatest(_int(F.floor(_len(x) / n_segments)), F.lit(1))
    seg = lambda t: F.least(F.floor(t / size), F.lit(n_segments - 1))
    order = F.array_sort(F.transform(A.steps(_len(x)), lambda t: F.struct(seg(t).alias("s"), d.u("step", *SAMPLE, t).alias("u"), t.alias("t"))))
    return F.transform(order, lambda o: F.get(x, o["t"]))


@transform
def time_noise(x, d, max_jitter=0.1):
    """Each step reads a place up to int(L j) steps away, alike in all variables of a sample."""
    k = F.floor(_len(x) * max_jitter)
    return F.transform(x, lambda v, t: A.lookup(x, t + (2 * d.u("step", *SAMPLE, t) - 1) * k))


@transform
def time_warp(x, d, magnitude=0.2, n_knots=4):
    """Each step reads a place moved by lines through ``n_knots`` offsets, none at both ends."""
    k = [F.lit(0.0), *[(2 * d.u(f"knot{i}") - 1) * magnitude * _len(x) for i in range(n_knots)], F.lit(0.0)]
    return A.let(_knots(x, k), lambda off: F.transform(x, lambda v, t: A.lookup(x, t + F.get(off, t))))


@transform
def window_warp(x, d, window_ratio=0.1, scales=(0.5, 2.0)):
    """One window is resampled by a scale, then the whole to its old length."""
    w = F.greatest(_int(_len(x) * window_ratio), F.lit(1))
    s = _int(d.u("start") * (_len(x) - w + 1))
    scale = F.get(F.array(*[F.lit(float(v)) for v in scales]), _int(d.u("scale") * len(scales)))
    mid = A.lerp(F.slice(x, s + 1, w), F.greatest(_int(w * scale), F.lit(1)), "short")
    return A.lerp(F.concat(F.slice(x, F.lit(1), s), mid, F.slice(x, s + w + 1, _len(x))), _len(x), "short")


# smoothing


@transform
def blur(x, d, kernel_size=5, sigma=1.0):
    """Gaussian window, weights inside the series scaled to 1; shorter series stay."""
    import math

    half = kernel_size // 2
    w = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(kernel_size)]
    return F.when(_len(x) >= kernel_size, A.weighted(x, w, "inside")).otherwise(x)


#: Quadratic smoothing weights for windows of 3, 5 and 7.
SAVITZKY_GOLAY = {3: [0.25, 0.5, 0.25], 5: [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35], 7: [-2 / 21, 3 / 21, 6 / 21, 7 / 21, 6 / 21, 3 / 21, -2 / 21]}


@transform
def smooth(x, d, method="moving_average", window_size=5, alpha=0.3):
    """``moving_average``, ``exponential`` (begun at the first value) or ``savitzky_golay`` (edges scaled by absolute weights; flat weights for other windows)."""
    if method == "moving_average":
        return A.running_mean(x, window_size)
    if method == "exponential":
        first = F.struct(F.get(x, F.lit(0)).alias("s"), F.array().cast("array<double>").alias("out"))

        def step(a, v):
            s = alpha * v + (1 - alpha) * a["s"]
            return F.struct(s.alias("s"), F.concat(a["out"], F.array(s)).alias("out"))

        return F.aggregate(x, first, step, lambda a: a["out"])
    return A.weighted(x, SAVITZKY_GOLAY.get(window_size, [1 / window_size] * window_size), "absolute")


@transform
def freq_denoise(x, d, cutoff=0.3, order=3, length=None):
    """``order`` moving averages over clamp(round(1 / cutoff), 3, L / 2) steps, made odd around each step."""
    w = max(3, int(1 / cutoff + 0.5))
    if length:
        w = min(w, max(length // 2, 1))
    for _ in range(order):
        x = A.running_mean(x, 2 * (w // 2) + 1)
    return x


@transform
def random_conv(x, d, kernel_sizes=(3, 5, 7), preserve_mean=True):
    """A random odd kernel a series, scaled to sum 1, edges repeated; the mean is restored if asked."""
    k = F.get(F.array(*[F.lit(s) for s in kernel_sizes]), _int(d.u("size", *SERIES) * len(kernel_sizes)))
    raw = F.transform(A.steps(k), lambda j: d.u("weight", *SERIES, j) + 0.1)
    weights = A.let(raw, lambda r: A.let(A.total(r), lambda s: F.transform(r, lambda v: v / s)))
    place = lambda t, j, w: F.least(F.greatest(t + j - F.floor(F.size(w) / 2), F.lit(0)), _len(x) - 1).cast("int")
    y = A.let(weights, lambda w: F.transform(x, lambda v, t: F.aggregate(A.steps(F.size(w)), F.lit(0.0), lambda a, j: a + F.get(w, j) * F.get(x, place(t, j, w)))))
    if not preserve_mean:
        return y
    return A.let(y, lambda y: A.let((A.total(x) - A.total(y)) / _len(x), lambda s: F.transform(y, lambda v: v + s)))


# length


@transform
def resize_back(x, d, lo=0.8, hi=1.2, kernel="ends"):
    """Resampled to a random ratio of its length and back."""
    n = F.greatest(_int(_len(x) * d.between(lo, hi, "ratio")), F.lit(2))
    return A.lerp(A.lerp(x, n, kernel), _len(x), kernel)


@transform
def random_size(x, d, min_ratio=0.8, max_ratio=1.2):
    """Resampled to a random ratio of its length and back, ends on ends."""
    n = F.greatest(_int(_len(x) * d.between(min_ratio, max_ratio, "ratio")), F.lit(2))
    return A.lerp(A.lerp(x, n), _len(x))


@transform
def random_time_scale(x, d, lo=0.8, hi=1.2):
    """Resampled to L / scale and back."""
    n = F.greatest(_int(_len(x) / d.between(lo, hi, "scale")), F.lit(2))
    return A.lerp(A.lerp(x, n), _len(x))


@transform
def down_up_scale(x, d, scale=0.5):
    """Down to int(L scale) steps and back."""
    return A.lerp(A.lerp(x, F.greatest(_int(_len(x) * scale), F.lit(2))), _len(x))


@transform
def random_low_res(x, d, lo=0.3, hi=0.7):
    """As down_up_scale with a random scale."""
    return A.lerp(A.lerp(x, F.greatest(_int(_len(x) * d.between(lo, hi, "scale")), F.lit(2))), _len(x))


@transform
def random_time_step(x, d, min_step=1, max_step=3):
    """Every k-th step, resized back."""
    k = _int(min_step + F.floor(d.u("k") * (max_step - min_step + 1)))
    return A.let(k, lambda k: A.lerp(F.filter(x, lambda v, t: t % k == 0), _len(x)))


@transform
def resample_steps(x, d, n_steps=50):
    """Down to ``n_steps`` and back; shorter series stay."""
    return F.when(_len(x) > n_steps, A.lerp(A.lerp(x, n_steps), _len(x))).otherwise(x)


@transform
def random_resized_crop(x, d, min_ratio=0.5, max_ratio=1.0):
    """A crop of each sample, resized back."""
    n = F.greatest(_int(_len(x) * d.between(min_ratio, max_ratio, "ratio", *SAMPLE)), F.lit(1))
    s = _int(d.u("start", *SAMPLE) * (_len(x) - n + 1))
    return A.lerp(F.slice(x, s + 1, n), _len(x), "short")


@transform
def window_slicing(x, d, window_ratio=0.9, resize=True):
    """A window of int(L r) steps, resized back or left short."""
    n = F.greatest(_int(_len(x) * window_ratio), F.lit(1))
    cut = F.slice(x, _int(d.u("start") * (_len(x) - n + 1)) + 1, n)
    return A.lerp(cut, _len(x)) if resize else cut


def _centred(x: Column, y: Column, value: float) -> Column:
    left = _int(F.floor((_len(x) - _len(y)) / 2))
    return F.concat(F.array_repeat(F.lit(value), left), y, F.array_repeat(F.lit(value), _len(x) - _len(y) - left))


@transform
def random_crop_pad(x, d, min_crop_ratio=0.5, max_crop_ratio=1.0, pad_value=0.0):
    """A crop in the middle of ``pad_value``."""
    n = F.greatest(_int(_len(x) * d.between(min_crop_ratio, max_crop_ratio, "ratio")), F.lit(1))
    return _centred(x, F.slice(x, _int(d.u("start") * (_len(x) - n + 1)) + 1, n), pad_value)


@transform
def random_zoom_out(x, d, min_zoom=0.5, max_zoom=1.0, pad_value=0.0):
    """Shrunk to int(L z) steps in the middle of ``pad_value``; nothing from z = 0.99 on."""
    z = d.between(min_zoom, max_zoom, "zoom")
    return F.when(z < 0.99, _centred(x, A.lerp(x, F.greatest(_int(_len(x) * z), F.lit(1))), pad_value)).otherwise(x)


def resize(df: DataFrame, target_len: int = 100) -> DataFrame:
    """Linear resampling of every split to ``target_len`` steps; no gate."""
    return df.withColumn("x", A.lerp("x", target_len))


def identity(df: DataFrame, **_) -> DataFrame:
    return df


def haar_dwt(df: DataFrame) -> DataFrame:
    """Adds ``approx`` and ``detail``: (even ± odd) / sqrt 2 over the even part of the length."""
    half = A.steps(F.floor(F.size("x") / 2))
    root = 1.4142135623730951
    pick = lambda s: F.transform(half, lambda i: (F.get("x", 2 * i) + s * F.get("x", 2 * i + 1)) / root)
    return df.withColumn("approx", pick(1)).withColumn("detail", pick(-1))


def spec_augment(df: DataFrame, *, seed: int = 42, split: str = "train", n_vars: int = 1, **settings) -> DataFrame:
    """frequency_mask, then time_mask under the next seed."""
    freq = {k: v for k, v in settings.items() if k.startswith("freq")}
    time = {k: v for k, v in settings.items() if k.startswith("time")}
    return REGISTRY["time_mask"](REGISTRY["frequency_mask"](df, p=1, seed=seed, split=split, n_vars=n_vars, **freq), p=1, seed=seed + 1, split=split, **time)


def compose(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


#: Operations of rand_augment with their setting as a function of the magnitude m.
RAND_AUGMENT = {
    "gaussian_noise": lambda m: {"std": 0.3 * m}, "mag_add_noise": lambda m: {"magnitude": 0.2 * m}, "mag_mul_noise": lambda m: {"magnitude": 0.2 * m}, "time_warp": lambda m: {"magnitude": 0.4 * m},
    "mag_warp": lambda m: {"sigma": 0.3 * m}, "window_warp": lambda m: {"window_ratio": 0.3 * m}, "mag_scale": lambda m: {"factor": 1 + 0.5 * m}, "cutout": lambda m: {"max_cut_ratio": 0.3 * m},
    "mask_out": lambda m: {"max_mask_ratio": 0.2 * m}, "random_shift": lambda m: {"max_shift": 0.3 * m}, "permutation": lambda m: {"n_segments": max(2, round(10 * m))}, "rotation": lambda m: {"max_rotation": 0.5 * m}, "flip_time": lambda m: {},
}


def rand_augment(df: DataFrame, n: int = 2, magnitude: float = 0.5, seed: int = 42, split: str = "train") -> DataFrame:
    """``n`` operations drawn with replacement, each applied."""
    import hashlib

    names = list(RAND_AUGMENT)
    for i in range(n):
        name = names[int(hashlib.md5(f"{seed}:rand_augment:{i}".encode()).hexdigest()[:8], 16) % len(names)]
        df = REGISTRY[name](df, p=1, seed=seed + i, split=split, **RAND_AUGMENT[name](magnitude))
    return df


def shuffle_highs_lows(df: DataFrame, high: int = 1, low: int = 2, *, seed: int = 42, split: str = "train") -> DataFrame:
    """Highs and lows of each sample shuffled independently, then swapped where low exceeds high. Both variables meet by a grouping on the sample."""
    if split != "train":
        return df
    d = Draw(df, seed, "shuffle_highs_lows")

    def shuffled(what):
        order = F.array_sort(F.transform(A.steps(F.size("x")), lambda t: F.struct(d.u(what, *SAMPLE, t).alias("u"), t.alias("t"))))
        return F.transform(order, lambda o: F.get("x", o["t"]))

    x = F.when(F.col("var_id") == high, shuffled("high")).when(F.col("var_id") == low, shuffled("low")).otherwise(F.col("x"))
    moved = df.withColumn("x", x)
    two = moved.where(F.col("var_id").isin(high, low)).groupBy("sample_id").agg(F.max(F.when(F.col("var_id") == high, F.col("x"))).alias("_h"), F.max(F.when(F.col("var_id") == low, F.col("x"))).alias("_l"))
    both = F.zip_with("_h", "_l", lambda a, b: F.when(F.col("var_id") == high, F.greatest(a, b)).otherwise(F.least(a, b)))
    return moved.join(two, "sample_id", "left").withColumn("x", F.when(F.col("var_id").isin(high, low), both).otherwise(F.col("x"))).select(*df.columns)
