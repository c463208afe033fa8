"""Column functions that clean and recode subject fields.  NULL is the only missing value they return, unless a marker is asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing field.
MISSING = ("", "#N/A", "NA", "N/A", "nan", "None")
MARKER = "[missing]"
#: Fixed values of the optics: extinction coefficients (HbO, HbR) in 1/cm per mol/l at each wavelength in nm.
COEFFICIENTS = {690: (276.0, 2051.96), 695: (300.16, 1841.05), 830: (974.0, 693.04)}


def normalize_missing(c: Column) -> Column:
    """Trimmed text, with every spelling of a missing value replaced by the marker."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.isin(*MISSING), F.lit(MARKER)).otherwise(t)


def clean_category(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(*MISSING, MARKER), t)


def parse_age(c: Column) -> Column:
    """Whole years, cut off; NULL where missing or no number."""
    return F.trim(c).try_cast("double").cast("int")


def clean_range(c: Column, low: float = 9, high: float = 20) -> Column:
    n = F.trim(c).try_cast("double")
    return F.when(n.between(low, high), n)


def age_bin(c: Column) -> Column:
    age = parse_age(c)
    return (
        F.when(age.isNull(), MARKER).when((age < 9) | (age > 20), "abnormal").when(age <= 11, "9-11").when(age <= 14, "12-14").when(age <= 17, "15-17").otherwise("18-20")
    )


def category_group(c: Column, groups: Mapping[str, str]) -> Column:
    t = normalize_missing(c)
    chosen = F.when(t == MARKER, MARKER)
    for value, group in groups.items():
        chosen = chosen.when(t == value, group)
    return chosen.otherwise("other")


def presence_pattern(flags: Mapping[str, Column]) -> Column:
    """A letter per flag: capital if set, small if not."""
    return F.concat(*[F.when(c == 1, k.upper()).otherwise(k.lower()) for k, c in flags.items()])


def presence_count(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for c in flags:
        total = total + F.when(c == 1, 1).otherwise(0)
    return total


def cohort_flags(label: Column, modalities: Sequence[Column], extra: Column) -> dict[str, Column]:
    labelled = F.coalesce(label.isin("0", "1"), F.lit(False))
    n = presence_count(modalities)
    covered = labelled & (n + F.when(extra == 1, 1).otherwise(0) > 0)
    return {
        "labelled": labelled,
        "coverage_maximized": covered,
        "matched": labelled & (n == len(modalities)),
        "missing_modality": covered & ~((n == len(modalities)) & (extra == 1)),
    }


def derive_label(c: Column, negative: Sequence[str], positive: Sequence[str]) -> Column:
    """0 or 1 by the named values; any other value is left out (NULL)."""
    return F.when(c.isin(*negative), 0).when(c.isin(*positive), 1)


def extract_ids(text: Column, pattern: str = r"(?<![A-Za-z0-9])([A-Za-z]\d{5})(?![A-Za-z0-9])") -> Column:
    """All ids with clear borders, in capitals."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper)


def redact_names(text: Column) -> Column:
    return F.regexp_replace(text, r"[一-鿿]{2,4}", "<name>")


def normalize_code(c: Column) -> Column:
    """Whole numbers without their decimals; other text as it is; blank as empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    n = t.try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)), n.cast("long").cast("string")).otherwise(t)


def map_codes(c: Column, mapping: Mapping[str, str], default: str = "") -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), normalize_code(c)), F.lit(default))


def hmsms_to_seconds(c: Column) -> Column:
    """Seconds of H:M:S:ms; NULL unless there are exactly four whole numbers."""
    p = F.split(F.trim(c), ":")
    h, m, s, ms = [F.try_element_at(p, F.lit(i + 1)).try_cast("int") for i in range(4)]
    return F.when(F.size(p) == 4, h * 3600.0 + m * 60.0 + s + ms / 1000.0)


def group_prefix(c: Column, n: int) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) >= n, F.substring(t, 1, n)).otherwise(MARKER)


def stable_hash(c: Column) -> Column:
    return F.sha1(c.cast("string"))


def stable_number(*parts: Column | str | int) -> Column:
    """A number below 2**32 from the first 8 hex digits of the SHA-1 of the parts, joined by bars."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(c, F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def pathlength_factor(wavelength: Column, age: Column) -> Column:
    """Differential path length factor by wavelength (nm) and age, from the published closed form."""
    a = F.least(F.greatest(F.coalesce(age, F.lit(13.0)), F.lit(1.0)), F.lit(50.0))
    return 223.3 + 0.05624 * F.pow(a, 0.8493) - 5.723e-7 * F.pow(wavelength, 3) + 0.001245 * F.pow(wavelength, 2) - 0.9025 * wavelength


def region_label(x: Column, y: Column) -> Column:
    side = F.when(x < -20, "left").when(x > 20, "right").otherwise("mid")
    depth = F.when(y > 50, "frontopolar").when(y > 20, "anterior").when(y > -10, "central").otherwise("posterior")
    return F.concat_ws("_", side, depth)


def gate_reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The reasons of the rules that hold, in order, joined by semicolons; empty if none."""
    return F.concat_ws(";", *[F.when(condition, reason) for condition, reason in rules])


def expand_box(x0: Column, y0: Column, x1: Column, y1: Column, scale: float, width: int, height: int) -> list[Column]:
    """The box scaled about its centre and cut to the frame."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    hw, hh = (x1 - x0) / 2 * scale, (y1 - y0) / 2 * scale
    zero = F.lit(0.0)
    return [F.greatest(cx - hw, zero), F.greatest(cy - hh, zero), F.least(cx + hw, F.lit(float(width))), F.least(cy + hh, F.lit(float(height)))]


def clean_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9A-Za-z]+", "_")


def pupil_mean(left: Column, right: Column) -> Column:
    left, right = F.nullif(left, F.lit(float("nan"))), F.nullif(right, F.lit(float("nan")))
    return F.coalesce((left + right) / 2, left, right)


def path_digest(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def issue_status(rules: Sequence[tuple[Column, str]], fatal: Column) -> tuple[Column, Column]:
    """Status (ok, warn, fail) and the issue codes joined by bars."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in rules]))
    return F.when(fatal, "fail").when(F.size(codes) > 0, "warn").otherwise("ok"), F.array_join(codes, "|")
