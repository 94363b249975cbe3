"""Scalar rules as column expressions; nothing here shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def llround(x: Column) -> Column:
    """Half away from zero, as a long."""
    return F.round(x).cast("long")


def upper_median(x) -> Column:
    """Aggregate: the middle value, the upper one of an even number; null of none."""
    values = F.sort_array(F.collect_list(col(x)))
    return F.when(F.size(values) > 0, F.get(values, F.floor(F.size(values) / 2).cast("int")))


def frame_to_sample(frame, hop: float, hop_scale: float = 1.0, latency_s: float = 0.0, sample_rate: float = 1.0) -> Column:
    return F.greatest(llround(col(frame) * (hop * hop_scale)) - llround(F.lit(latency_s * sample_rate)), F.lit(0))


def sample_to_frame(sample, hop: float, hop_scale: float = 1.0) -> Column:
    return llround(col(sample) / hop_scale / hop)


def logits_to_prob(x, temperature: float = 1.0) -> Column:
    """Stable sigmoid of x / T; a temperature of 0 or less counts as 1."""
    z = col(x) / (temperature if temperature > 0 else 1.0)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def normalize_bpm(bpm, low: float, high: float, steps: int = 8) -> Column:
    """Fold by octaves while the result stays inside the range, then clamp; what is not positive passes."""
    high = max(low + 1, high)
    fold = lambda x, _: F.when((x < low) & (x * 2 <= high), x * 2).when((x > high) & (x / 2 >= low), x / 2).otherwise(x)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), col(bpm).cast("double"), fold)
    return F.when(col(bpm) > 0, F.greatest(F.lit(low), F.least(F.lit(high), x))).otherwise(col(bpm))


def tempo_window(reference, width: float, low: float, high: float) -> tuple[Column, Column]:
    """Clamped window around a reference tempo; the hard range where that is empty or there is no reference."""
    ref = col(reference)
    a, b = F.greatest(ref * (1 - width), F.lit(low)), F.least(ref * (1 + width), F.lit(high))
    ok = (ref > 0) & (a < b)
    return F.when(ok, a).otherwise(F.lit(low)), F.when(ok, b).otherwise(F.lit(high))


#: Factors of tempo modes, and their penalties where probes are compared.
FUSION_FACTORS = [0.5, 1.0, 2.0, 3.0, 2 / 3, 1.5]
PROBE_FACTORS = [0.5, 1.0, 2.0]


def expand_modes(bpm, confidence, low: float, high: float, factors: list[float]) -> Column:
    """Array of (factor, bpm) of the modes inside the range; empty without tempo or confidence."""
    modes = F.array(*[F.struct(F.lit(f).alias("factor"), (col(bpm) * f).alias("bpm")) for f in factors])
    ok = (col(bpm) > 0) & (col(confidence) > 0)
    return F.filter(modes, lambda m: ok & (m["bpm"] >= low) & (m["bpm"] <= high))


def round_bpm(low, center, high) -> Column:
    """Snap a tempo to an integer inside its band, else to halves, multiples of 1.5 or twelfths by band and tempo."""
    lo, c, hi = col(low), col(center), col(high)
    inside = lambda x: (x > lo) & (x < hi)
    whole, twelfth = F.round(c), F.round(c * 12) / 12
    wide = hi - lo
    broad = F.when(c < 85, F.round(c * 2) / 2).when(c > 127, F.round(c / 3 * 2) * 3 / 2).otherwise(twelfth)
    return F.when(inside(whole), whole).when(wide > 0.5, broad).when(wide > 1.0 / 12, twelfth).when(inside(twelfth), twelfth).otherwise(c)


def phase_limits(bpm) -> tuple[Column, Column]:
    """Limits in ms of the signed and the absolute phase error; 500 ms a beat without a tempo."""
    beat = F.when(col(bpm) > 0, 60000.0 / col(bpm)).otherwise(500.0)
    return F.greatest(F.lit(30.0), 0.12 * beat), F.greatest(F.lit(45.0), 0.18 * beat)


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def usability_score(onset, period, transient, silence, instability) -> Column:
    return (0.30 * clamp01(onset) + 0.40 * clamp01(period) + 0.30 * clamp01(transient)) - (0.20 * clamp01(silence) + 0.35 * clamp01(instability))


def is_usable(period, transient, silence, instability) -> Column:
    quiet = (col(silence) >= 0.98) & (col(period) < 0.50)
    return ~quiet & (col(period) >= 0.35) & (col(transient) >= 0.25) & (col(instability) <= 0.70)


def interior_score(n, median_abs, abs_ratio, signed_ratio, odd_even) -> Column:
    """Lower is better; null with few beats, a missing metric or a signed ratio of 0.85 and more."""
    ok = (col(n) >= 8) & (col(signed_ratio) < 0.85)
    return F.when(ok, col(median_abs) + 60 * col(abs_ratio) + 40 * col(signed_ratio) + 0.25 * col(odd_even))


def probe_quality(bpm, confidence, phase_abs_ms, n_beats) -> Column:
    damp = F.coalesce(1 / (1 + col(phase_abs_ms) / 120), F.lit(0.15))
    return F.when((col(bpm) > 0) & (col(n_beats) >= 4), col(confidence) * F.least(F.lit(1.0), col(n_beats) / 24) * damp).otherwise(0.0)


def probe_usable(bpm, confidence, phase_abs_ms, n_beats) -> Column:
    return (col(bpm) > 0) & (col(n_beats) >= 16) & (col(confidence) >= 0.55) & F.coalesce(col(phase_abs_ms) <= 120, F.lit(True))


def accept_opening_guard(base_intro, base_outro, cand_intro, cand_outro, gain=15.0) -> Column:
    """Whether a new opening is taken: a bad intro, a good outro, a clear gain and little harm to the outro."""
    rules = [
        col(base_intro) >= 45,
        col(base_outro) <= 40,
        col(base_intro) - col(cand_intro) >= gain,
        col(cand_intro) <= col(base_intro) - 10,
        col(cand_outro) - col(base_outro) <= 12,
        col(cand_outro) <= 50,
    ]
    return reduce(lambda a, b: a & b, rules)


#: Bits of the event style.
STYLES = ["beat", "bar", "found", "alarm_intro", "alarm_buildup", "alarm_teardown", "alarm_outro", "intro", "buildup", "teardown", "outro", "start", "end", "chapter"]
STYLE = {name: 1 << i for i, name in enumerate(STYLES)}


def event_style(index, n_beats, phase=0) -> Column:
    """Style bits of a beat of its track: bar by phase, section marks and alarms by beat count.

    Sections open 32 and 64 bars from either end, half of that in tracks of fewer than 192 bars; a section
    longer than the track is never reached.
    """
    i, n, ph = col(index), col(n_beats), col(phase)
    bars = F.shiftright(n, 2)
    short = bars < 192
    intro, buildup = F.when(short, 16).otherwise(32), F.when(short, 32).otherwise(64)
    intro_at, buildup_at = ph + 4 * intro, ph + 4 * buildup
    teardown_at = F.coalesce(F.when(bars >= buildup, ph + 4 * (bars - buildup)), F.lit(2**62))
    outro_at = F.coalesce(F.when(bars >= intro, ph + 4 * (bars - intro)), F.lit(2**62))
    bit = lambda name: F.lit(STYLE[name])
    parts = [
        F.lit(STYLE["beat"] | STYLE["found"]),
        F.when(i % 4 == ph, bit("bar")).otherwise(0),
        F.when(i == 0, bit("start")).when(i == intro_at, bit("intro")).when(i == buildup_at, bit("buildup")).when(i == teardown_at, bit("teardown")).when(i == outro_at, bit("outro")).otherwise(0),
        F.when(i >= outro_at, bit("alarm_outro")).when(i >= teardown_at, bit("alarm_teardown")).when(i < intro_at, bit("alarm_intro")).when(i < buildup_at, bit("alarm_buildup")).otherwise(0),
        F.when(i == n - 1, bit("end")).otherwise(0),
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts).cast("long")
