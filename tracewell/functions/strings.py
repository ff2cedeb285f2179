"""Column functions over paths, labels, models, numbers and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import half_up, trimmed

MINUTE, HOUR, DAY, WEEK = 60, 3600, 86_400, 604_800
#: What a public name of a model or provider looks like, and its greatest length.
PUBLIC, MODEL_LENGTH, PROVIDER_LENGTH = r"^[a-z0-9][a-z0-9._:-]*$", 128, 64


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """What comes before the last slash; "." where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def path_tokens(path: Column) -> Column:
    """Lower-case parts between slashes, dots, underscores and hyphens; no empty ones."""
    return F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != "")


def renamed(path: Column) -> Column:
    """The new path of a rename: "a/{b => c}/d" or "old => new"; other paths stay."""
    braces = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    arrow = F.regexp_replace(path, r"^.*? => ", "")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braces).otherwise(arrow)


def display_label(text: Column, most: int = 120) -> Column:
    """Control and format characters and white space runs become one space; trimmed, at most ``most`` code points."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " "), r"(?U)\s+", " "))
    return F.rtrim(F.substring(clean, 1, most))


def provider(name: Column) -> Column:
    """A provider in lower case; unknown where null or blank, custom where it is no public name."""
    low = F.lower(trimmed(name))
    return F.when(F.coalesce(low, F.lit("")) == "", "unknown").when((F.char_length(low) <= PROVIDER_LENGTH) & low.rlike(PUBLIC), low).otherwise("custom")


def model(provider_name: Column, name: Column) -> Column:
    """struct(provider, id): the last part of the id in lower case; a private id is custom and makes its provider custom, but for opencode."""
    blank = (F.coalesce(trimmed(provider_name), F.lit("")) == "") | (F.coalesce(trimmed(name), F.lit("")) == "")
    last = F.lower(F.element_at(F.split(trimmed(name), "/"), -1))
    public = (F.char_length(last) <= MODEL_LENGTH) & last.rlike(PUBLIC)
    own = provider(provider_name)
    pair = lambda p, i: F.struct(p.alias("provider"), i.alias("id"))
    private = pair(F.when(own == "opencode", "opencode").otherwise("custom"), F.lit("custom"))
    return F.when(blank, pair(F.lit("unknown"), F.lit("unknown"))).when(public, pair(own, last)).otherwise(private)


def _fixed(x: Column, digits: int) -> Column:
    """``digits`` digits of the double itself, not of its shortest text: 1.45, which is a little less, gives 1.4; what lies exactly between goes up."""
    x = x.cast("double")
    scaled = x * float(10**digits)
    between = (x * 1024.0 == F.floor(x * 1024.0)) & (scaled - F.floor(scaled) == 0.5)
    return F.replace(F.format_number(F.when(between, (F.floor(scaled) + 1) / float(10**digits)).otherwise(x), digits), F.lit(","), F.lit(""))


def tokens_text(n: Column) -> Column:
    """999, 1.2k, 12k, 1.2M, 12M."""
    whole = lambda k: half_up(n / k, 0).cast("long").cast("string")
    return (
        F.when(n < 1000, n.cast("string")).when(n < 10_000, F.concat(_fixed(n / 1000, 1), F.lit("k"))).when(n < 1_000_000, F.concat(whole(1000), F.lit("k")))
        .when(n < 10_000_000, F.concat(_fixed(n / 1e6, 1), F.lit("M"))).otherwise(F.concat(whole(1_000_000), F.lit("M")))
    )


def cost_text(x: Column) -> Column:
    """Two digits from 1 on, else three."""
    return F.concat(F.lit("$"), F.when(x >= 1, _fixed(x, 2)).otherwise(_fixed(x, 3)))


def window_label(seconds: Column) -> Column:
    """week, 3d, 5h or minutes."""
    s = seconds.cast("long")
    part = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(name))
    return F.when(s == WEEK, "week").when((s >= DAY) & (s % DAY == 0), part(DAY, "d")).when((s >= HOUR) & (s % HOUR == 0), part(HOUR, "h")).otherwise(F.concat(half_up(s / MINUTE, 0).cast("long").cast("string"), F.lit("m")))


def reset_text(seconds: Column) -> Column:
    """When a window resets, from the seconds left; empty for null."""
    s = seconds.cast("long")
    n = lambda x: F.floor(x).cast("string")
    minutes = F.greatest(F.lit(1), half_up(s / MINUTE, 0).cast("long")).cast("string")
    return (
        F.when(s.isNull(), "").when(s <= 0, "resets now").when(s < HOUR, F.concat(F.lit("resets in "), minutes, F.lit("m")))
        .when(s < DAY, F.concat(F.lit("resets in "), n(s / HOUR), F.lit("h "), n(s % HOUR / MINUTE), F.lit("m")))
        .otherwise(F.concat(F.lit("resets in "), n(s / DAY), F.lit("d "), n(s % DAY / HOUR), F.lit("h")))
    )


def age_text(ms: Column) -> Column:
    """How long ago, by its largest unit: 999ms, 59s, 59m, 23h, 5d; what lies ahead is 0ms."""
    ms = F.greatest(ms.cast("long"), F.lit(0))
    n = lambda unit, name: F.concat(F.floor(ms / (unit * 1000)).cast("string"), F.lit(name))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < MINUTE * 1000, n(1, "s")).when(ms < HOUR * 1000, n(MINUTE, "m")).when(ms < DAY * 1000, n(HOUR, "h")).otherwise(n(DAY, "d"))


def elapsed_text(ms: Column) -> Column:
    """59s, 1m05s, 2h07m; what is below zero is 0s."""
    s = F.greatest(F.floor(ms / 1000).cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(s / MINUTE)
    return (
        F.when(s < MINUTE, F.concat(s.cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), two(s % MINUTE), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), two(minutes % 60), F.lit("m")))
    )
