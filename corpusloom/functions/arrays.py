"""Functions of arrays and numbers, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples of a position, and samples a second (fixed values of the token rate: 50 positions a second).
SAMPLES, RATE = 320, 16_000


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def positions(samples: Column) -> Column:
    """Whole positions in a number of samples."""
    return F.floor(samples / SAMPLES).cast("long")


def trimmed(samples: Column) -> Column:
    """Samples cut to whole positions."""
    return positions(samples) * SAMPLES


def resampled_frames(frames: Column, rate: Column) -> Column:
    """Trimmed samples at the token rate of audio with so many frames; 0 where it couldn't be read."""
    return F.coalesce(trimmed(F.floor(frames * RATE / F.nullif(rate, F.lit(0)))), F.lit(0).cast("long"))


def mono(channels: Column) -> Column:
    """One signal (ARRAY<FLOAT>) of an array of channels: their mean, sample by sample, as long as the longest; null of none. Decoding and resampling to
    ``RATE`` come before, by functions of the caller (``registry.model_column``)."""
    n = F.array_max(F.transform(channels, lambda x: F.size(x)))
    mean = lambda i: F.aggregate(channels, F.lit(0.0), lambda s, x: s + F.coalesce(F.get(x, i), F.lit(0.0))) / F.size(channels)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: mean(i).cast("float"))).when(n == 0, F.array().cast("array<float>"))


def fitted(signal: Column, samples: Column) -> Column:
    """A signal cut, or filled up with zeros, to exactly so many samples, so that its positions are those that were packed."""
    n = samples.cast("int")
    return F.concat(F.slice(signal, F.lit(1), n), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n - F.size(signal), F.lit(0))))


def position_ids(lengths: Column) -> Column:
    """0..n-1 for each document of a block."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def offsets(lengths: Column) -> Column:
    """0 and the running sums: where documents begin, and the end."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, start, lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))


def mask_labels(ids: Column, masked: Column, value: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(F.array_contains(masked, x), F.lit(value)).otherwise(x))


def shifted(ids: Column) -> Column:
    """Without the first: the labels of a step ahead."""
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def flattened(nested: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        nested = F.flatten(nested)
    return nested


def crop(ids: Column, first: int, last: int) -> Column:
    """What stands between the markers; a missing marker is the end on its side."""
    a = F.array_position(ids, F.lit(first)).cast("int")
    b = F.array_position(ids, F.lit(last)).cast("int")
    stop = F.when(b > 0, b).otherwise(F.size(ids) + 1)
    return F.slice(ids, a + 1, F.greatest(stop - a - 1, F.lit(0)))


#: Seven slots of a frame of three code layers: (layer, offset in it, slot), and ids (fixed values of the codec).
SLOTS = ((0, 0, 0), (1, 0, 1), (2, 0, 2), (2, 1, 3), (1, 1, 4), (2, 2, 5), (2, 3, 6))
PER_FRAME = (1, 2, 4)
CODEBOOK, FIRST_CODE = 4096, 128_266


def interleaved(one: Column, two: Column, three: Column) -> Column:
    """Codes of three layers (1, 2 and 4 a frame) as seven ids a frame."""
    layers = (one, two, three)

    def frame(i):
        return F.array(*[F.get(layers[k], i * PER_FRAME[k] + j) + FIRST_CODE + s * CODEBOOK for k, j, s in SLOTS])

    n = F.size(one)
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), frame))).otherwise(F.array().cast("array<int>"))


def layers(ids: Column, first: int = FIRST_CODE) -> list[Column]:
    """The three layers of interleaved ids; an incomplete last frame is cut."""
    frames = F.floor(F.size(ids) / 7).cast("int")
    index = F.when(frames > 0, F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def layer(k: int) -> Column:
        slots = [s for owner, _, s in SLOTS if owner == k]
        return F.flatten(F.transform(index, lambda i: F.array(*[F.get(ids, i * 7 + s) - first - s * CODEBOOK for s in slots])))

    return [layer(k) for k in range(3)]


# --- vectors -------------------------------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column, floor: float = 1e-8) -> Column:
    """L2-normalised, the norm being ``floor`` at least."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


# --- numbers ----------------------------------------------------------------------------------------------------------------------------------


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Highest power first, by Horner's rule."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


#: Calibration of raw quality scores, highest power first (fixed values): plain and personalised.
CALIBRATION = {
    "OVRL": (-0.06766283, 1.11546468, 0.04602535),
    "SIG": (-0.08397278, 1.22083953, 0.0052439),
    "BAK": (-0.13166888, 1.60915514, -0.39604546),
}
CALIBRATION_PERSONAL = {
    "OVRL": (-0.00533021, 0.005101, 1.18058466, -0.11236046),
    "SIG": (-0.01019296, 0.02751166, 1.19576786, -0.24348726),
    "BAK": (-0.04976499, 0.44276479, -0.1644611, 0.96883132),
}


def calibrated(x: Column, kind: str, personal: bool = False) -> Column:
    return polynomial(x, (CALIBRATION_PERSONAL if personal else CALIBRATION)[kind])


def bin_index(x: Column, edges: Column, bins: int) -> Column:
    """Right-closed bins: edges below x, less one, within 0..bins-1; NaN goes to the lowest, null stays null."""
    below = F.size(F.filter(edges, lambda e: e < x)) - 1
    return F.when(x.isNull(), None).when(F.isnan(x), 0).otherwise(F.greatest(F.lit(0), F.least(below, F.lit(bins - 1))))


def bin_label(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), index)


#: Ordered labels of speech attributes (fixed values).
LABELS = {
    "speaking_rate": ("very slowly", "quite slowly", "slightly slowly", "moderate speed", "slightly fast", "quite fast", "very fast"),
    "noise": ("very noisy", "quite noisy", "slightly noisy", "moderate ambient sound", "slightly clear", "quite clear", "very clear"),
    "reverberation": ("very roomy sounding", "quite roomy sounding", "slightly roomy sounding", "moderate reverberation", "slightly confined sounding", "quite confined sounding", "very confined sounding"),
    "speech_monotony": ("very monotone", "quite monotone", "slightly monotone", "moderate intonation", "slightly expressive", "quite expressive", "very expressive"),
    "sdr": ("extremely noisy", "very noisy", "noisy", "slightly noisy", "almost no noise", "very clear"),
    "pesq": ("very bad speech quality", "bad speech quality", "slightly bad speech quality", "moderate speech quality", "great speech quality", "wonderful speech quality"),
    "pitch": ("very low pitch", "quite low pitch", "slightly low pitch", "moderate pitch", "slightly high pitch", "quite high pitch", "very high pitch"),
}


def hops(samples: Column, rate: int = RATE, seconds: float = 9.01) -> Column:
    """Windows of ``seconds``, one second apart, that whole seconds of audio hold; shorter audio is tiled up to one."""
    return F.greatest(F.lit(1), (F.floor(samples / rate) - seconds).cast("int") + 1)


def tiled(samples: Column, least: Column) -> Column:
    """Audio repeated until it has ``least`` samples."""
    times = F.ceil(least / F.size(samples)).cast("int")
    return F.slice(F.flatten(F.array_repeat(samples, F.greatest(times, F.lit(1)))), F.lit(1), F.greatest(least.cast("int"), F.size(samples)))


def windows(values: Column, size: int, hop: int) -> Column:
    """Windows of ``size`` values, ``hop`` apart; one at least."""
    n = F.greatest(F.lit(1), F.floor((F.size(values) - size) / hop).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * hop + 1, F.lit(size)))


def partial_windows(frames: Column, size: int, step: int, coverage: float = 0.8) -> Column:
    """First frames of windows: the whole ones, and one more if the frames that are left over would cover enough of it, or if there is no other."""
    room = F.greatest(frames - size + step, F.lit(0)).cast("int")
    whole, left = F.floor(room / step).cast("int"), F.pmod(room, F.lit(step))
    count = whole + F.when((whole == 0) | ((left + (size - step)) / size >= coverage), 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)


def fluency(p_fluent: Column, p_labels: Column, names: Sequence[str], fluent: float = 0.5, label: float = 0.7) -> Column:
    """"fluent" above the first threshold, else the names whose probability exceeds the second."""
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), p_labels.alias("p"))
    disfluent = F.transform(F.filter(named, lambda s: s["p"] > label), lambda s: s["name"])
    return F.when(p_fluent > fluent, F.array(F.lit("fluent"))).otherwise(disfluent)


def fluency_label(timestamps: Column, labels: Column) -> Column:
    """``00:03:fluent, 03:06:...`` from pairs of seconds and labels."""
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.lit(2), F.length(x.cast("string"))), F.lit("0"))
    return F.array_join(F.zip_with(timestamps, labels, lambda t, name: F.concat(two(t[0]), F.lit(":"), two(t[1]), F.lit(":"), name)), ", ")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
