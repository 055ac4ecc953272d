"""Scores, bands and labels as column expressions: one place per rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

# fixed values: lexicon of procedure talk, boilerplate, tone words, placeholders, shifts
PROTOCOL_PHRASES = (
    "head down", "copy that", "stand by", "standby", "say again", "box box", "box box box",
    "keep pushing", "push push", "understood", "negative", "affirmative", "roger", "wilco",
    "confirm", "confirmed", "check", "checking", "no change", "as we were", "go ahead",
)
PROTOCOL_TOKENS = (
    "box", "copy", "negative", "affirmative", "roger", "wilco", "standby", "over", "out",
    "understood", "confirm", "confirmed", "check", "yes", "no", "yeah", "yep", "ok", "okay",
    "right", "alright", "that", "it", "is", "we", "are", "on", "in", "and", "a", "the",
    "mate", "mode", "lap", "laps", "one", "two", "three", "four", "five", "six", "seven",
)
BOILERPLATE = ("thank you.", "thanks for watching!", "you", "bye.", "subtitles by the amara.org community", "♪")
TONE_WORDS = {
    "stressed": "stressed", "stress": "stressed", "stressful": "stressed", "calm": "calm", "relaxed": "calm",
    "tired": "tired", "fatigued": "tired", "exhausted": "tired",
}
PLACEHOLDERS = ("", "null", "none", "undefined", "nil", "n/a", "na", "-")
MOOD_SHIFT = {"stressed": -0.18, "tired": -0.10, "calm": 0.03}
NEUTRAL_BAND = DEFAULTS.neutral_band


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def round_half_up(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def reliability(duration: Column, snr: Column, clipping: Column, bandwidth: Column) -> Column:
    """How far a voice vector can be trusted; missing measures get cautious defaults."""
    d = F.sqrt(F.least(F.lit(1.0), duration / 8.0))
    q = clamp01((F.coalesce(snr, F.lit(10.0)) - 5.0) / 20.0)
    c = 1.0 - F.least(F.lit(1.0), F.coalesce(clipping, F.lit(0.0)) * 20.0)
    b = clamp01((F.coalesce(bandwidth, F.lit(4000.0)) - 3000.0) / 5000.0)
    return d * (0.5 + 0.5 * (0.5 * q + 0.3 * c + 0.2 * b))


def reliability_band(r: Column, p: Params = DEFAULTS) -> Column:
    return F.when(r >= p.reliability_good, "good").when(r >= p.reliability_fair, "fair").when(r >= p.reliability_poor, "poor").otherwise("unusable")


def quality_grade(snr: Column, clipping: Column, bandwidth: Column, p: Params = DEFAULTS) -> Column:
    good = (snr >= p.good_snr_db) & (clipping <= p.max_clipping) & (bandwidth >= p.min_bandwidth_hz)
    return F.when(good, "good").when(snr >= p.fair_snr_db, "fair").otherwise("poor")


def validation(has_audio: Column, duration: Column, header: Column, p: Params = DEFAULTS) -> tuple[Column, Column]:
    """(error code or OK, warnings): the first rule that fails decides."""
    code = (
        F.when(~has_audio, "NO_AUDIO_STREAM").when(duration > p.max_duration_s, "TOO_LONG").when(duration < p.min_duration_s, "TOO_SHORT")
        .when((header != 0) & (F.abs(header - duration) / F.greatest(duration, F.lit(1e-6)) > 0.10), "CORRUPT").otherwise("OK")
    )
    reached = ~code.isin("NO_AUDIO_STREAM", "TOO_LONG", "TOO_SHORT")
    return code, F.array_compact(F.array(F.when(reached & (duration > p.target_duration_s), "ABOVE_TARGET_DURATION")))


def speech_gate(speech: Column, flatness: Column, p: Params = DEFAULTS) -> Column:
    return F.when(speech >= p.min_speech_s, "OK").when(flatness < 0.4, "NO_SPEECH_DETECTED").otherwise("INSUFFICIENT_SPEECH")


def segment_quality(snr: Column, clipped: Column) -> Column:
    return 0.6 * clamp01((snr - 5.0) / 20.0) + 0.4 * (1.0 - F.least(F.lit(1.0), clipped * 20.0))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def too_short(text: Column, n: int) -> Column:
    return F.size(word_list(text)) < n


def is_protocol(text: Column) -> Column:
    """Whole utterance is procedure talk: a known phrase, only known tokens, or nothing at all."""
    tokens = word_list(F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", " "))
    return F.array_join(tokens, " ").isin(*PROTOCOL_PHRASES) | F.forall(tokens, lambda t: t.isin(*PROTOCOL_TOKENS))


def plain_label(label: Column) -> Column:
    x = F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit(" "))
    return (
        F.when(x == "label 0", "negative").when(x == "label 1", "neutral").when(x == "label 2", "positive")
        .when(F.contains(x, F.lit("negative")), "negative").when(F.contains(x, F.lit("positive")), "positive").otherwise("neutral")
    )


def signed_score(label: Column, score: Column) -> Column:
    x = plain_label(label)
    return F.when(x == "positive", score).when(x == "negative", -score).otherwise(0.0)


def band_label(score: Column, band: float = NEUTRAL_BAND) -> Column:
    return F.when(score > band, "positive").when(score < -band, "negative").otherwise("neutral")


def fused_score(signed: Column, mood: Column) -> Column:
    """Text score moved by the voice's mood; clipped only where a mood is known."""
    shift = F.lit(0.0)
    for name, by in MOOD_SHIFT.items():
        shift = F.when(mood == name, by).otherwise(shift)
    return F.when(F.coalesce(mood, F.lit("")) == "", signed).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signed + shift)))


def tone(voiced: Column, rate: Column, pitch_std: Column, base: Column | None = None) -> Column:
    """calm, tired or stressed; base: struct n, pitch_mean, pitch_std, rate of a session's calm speech."""
    p = DEFAULTS
    read = lambda slow, flat, fast, lively: F.when((rate < slow) & (pitch_std < flat), "tired").when((rate > fast) | (pitch_std > lively), "stressed").otherwise("calm")
    fixed = read(p.tone_slow, p.tone_flat, p.tone_fast, p.tone_lively)
    if base is not None:
        own = read(base["rate"] * p.tone_slow_x, base["pitch_std"] * p.tone_flat_x, base["rate"] * p.tone_fast_x, base["pitch_std"] * p.tone_lively_x)
        fixed = F.when((base["n"] >= p.tone_calm_least) & (base["pitch_mean"] > 0), own).otherwise(fixed)
    return F.when(voiced < p.tone_voiced_s, "calm").otherwise(fixed)


def is_placeholder(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*PLACEHOLDERS)


def tone_word(text: Column) -> Column:
    found = F.lit(None).cast("string")
    for word, mood in reversed(TONE_WORDS.items()):
        found = F.when(text.rlike(rf"(?i)\b{word}\b"), mood).otherwise(found)
    return found


def tone_phrase(mood: Column, sentiment: Column, score: Column, text_sentiment: Column) -> Column:
    """Hedged wording of both readings; a disagreement is said, not averaged away."""
    said = F.concat(F.lit("words read "), sentiment, F.coalesce(F.concat(F.lit(" ("), F.format_string("%+.2f", score), F.lit(")")), F.lit("")))
    return F.concat_ws(", ", F.concat(F.lit("voice reads "), mood), said, F.when(text_sentiment != sentiment, F.concat(F.lit("text alone reads "), text_sentiment)))


def parse_time(text: Column) -> Column:
    """ISO time with offset, Z or none (then UTC) as a timestamp; null for anything else."""
    t = F.regexp_replace(F.trim(text), r"[Zz]$", "+00:00")
    shaped = t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?([+-]\d\d:?\d\d)?)?$")
    zoned = F.when(t.rlike(r"[T ].*[+-]\d\d:?\d\d$"), t).otherwise(F.concat(F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t), F.lit("+00:00")))
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2")))
