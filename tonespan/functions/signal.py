"""Column functions of levels, pitch and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of a level: three rules for silence, none of which can replace another.
AT_LEAST, ADDED = "at least", "added"


def decibels(mean_square: Column, floor: float = 1e-10, rule: str = AT_LEAST) -> Column:
    """Level of a mean square; ``rule``: the root is at least ``floor``, or it is added."""
    root = F.sqrt(mean_square)
    return 20 * F.log10(F.greatest(root, F.lit(floor)) if rule == AT_LEAST else root + floor)


def audible_level(floor: Column, voice: Column, above: float = 6.0, below: float = 30.0) -> Column:
    return F.greatest(floor + above, voice - below)


def to_16bit(x: Column) -> Column:
    """Nearest 16-bit step, halves to even."""
    return F.least(F.greatest(F.rint(x * 32768), F.lit(-32768.0)), F.lit(32767.0)) / 32768


def pitch_hz(semitones: Column, low: float = 50.0, high: float = 500.0) -> Column:
    """Hz of semitones above 27.5 Hz; null if undefined (0) or out of range."""
    hz = 27.5 * F.pow(F.lit(2.0), semitones / 12)
    return F.when((semitones != 0) & hz.between(low, high), hz)


def gated_pitch(f0: Column, hnr: Column, least: float = 0.0) -> Column:
    return F.when(hnr > least, f0)


def formant(value: Column, f0: Column) -> Column:
    """A formant counts while the voice does."""
    return F.when(f0.isNotNull(), value)


def unit(vector: Column) -> Column:
    """Vector of length one; null for a zero vector."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-12)


def closest_frame(t: Column, step: float = 0.016875, duration: float = 0.0619375) -> Column:
    return F.rint((t - 0.5 * duration) / step).cast("long")


def safe_name(name: Column, speaker: Column) -> Column:
    """Letters, digits, space, - and _; at most 60 characters; else "speaker k+1"."""
    kept = F.trim(F.substring(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""), 1, 60))
    return F.when(F.length(kept) > 0, kept).otherwise(F.concat(F.lit("speaker "), (speaker + 1).cast("string")))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def output_key(threshold: Column, speech_only: Column, rev: Column) -> Column:
    """Key of derived output: the threshold, and the revision if only speech is kept."""
    return F.when(speech_only, F.concat(threshold.cast("string"), F.lit("-speech"), rev.cast("string"))).otherwise(threshold.cast("string"))


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat((whole / 60).cast("long").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


#: Round steps of a time axis, in seconds.
STEPS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0, 900.0, 1800.0, 3600.0)


def ticks(begin: Column, stop: Column, width: float, apart: float = 110.0) -> Column:
    """Ticks of a time axis ``width`` pixels wide: multiples of the least round step that
    keeps about ``apart`` pixels between them."""
    raw = (stop - begin) / F.lit(float(max(2, int(width // apart))))
    step = F.coalesce(*[F.when(raw <= s, F.lit(s)) for s in STEPS], F.lit(STEPS[-1]))
    first, last = F.ceil(begin / step - 1e-9), F.floor(stop / step + 1e-9)
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: F.round(k * step, 3))).otherwise(F.array().cast("array<double>"))


def hertz(x: Column) -> Column:
    """Whole hertz, halves to even; null stays null."""
    return F.concat(F.rint(x).cast("long").cast("string"), F.lit(" Hz"))


def decibel_text(x: Column) -> Column:
    return F.format_string("%.1f dB", x)


def full_clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss, rounded to whole seconds."""
    whole = F.floor(seconds + 0.5)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), (whole % 60)
    short = F.concat(m.cast("string"), F.lit(":"), F.lpad(s.cast("long").cast("string"), 2, "0"))
    long_ = F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(s.cast("long").cast("string"), 2, "0"))
    return F.when(h > 0, long_).otherwise(short)


def stamp_text(at: Column) -> Column:
    """Day and time of a moment in seconds since 1970, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd HH:mm")
