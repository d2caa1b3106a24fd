"""Scalar functions: columns in, columns out, unless a name ends in ``_value``."""

from __future__ import annotations

import hashlib
import html
import math
import struct
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body refers to it.

    A lambda re-evaluates whatever it closes over for each element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def missing(value: Column) -> Column:
    """Null, or blank once stripped."""
    return value.isNull() | (stripped(value.cast("string")) == "")


def number(value: Column) -> Column:
    """As double; null for what isn't a number."""
    return value.try_cast("double")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: no exponential of a positive number."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def calibrated(logit: Column, temperature: float) -> Column:
    return sigmoid(logit / F.lit(float(temperature)))


def order_bucket(x: Column) -> Column:
    """A long that never falls as ``x`` rises: logarithmic steps of 1/1024 from 0, and from 1 for numbers between 0.5 and 1.

    Sorted sums go by bucket and then within one, so that no task sorts all values. Null first, NaN last.
    """
    steps = lambda v: F.floor((F.ln(v) + 746) * 1024)
    turn = 2 * math.floor((math.log(0.5) + 746) * 1024) + 2
    v = x.cast("double")
    value = F.when(v < 0, -steps(-v)).when(v == 0, 0).when(v < 0.5, steps(v)).when(v < 1, turn - steps(1 - v)).when(v == float("inf"), turn + 2_000_000).otherwise(turn + steps(v))
    return F.when(v.isNull(), -(1 << 40)).when(F.isnan(v), 1 << 40).when(v == float("-inf"), -2_000_000).otherwise(value).cast("long")


def bce(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "High confidence").when(confidence >= 0.65, "Moderate confidence").otherwise("Low confidence")


def stability_rating(change: Column) -> Column:
    return F.when(change <= 0.02, "Stable under transformation").when(change <= 0.10, "Moderate probability shift").otherwise("Sensitive to transformation")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-fA-F]{64}\z"), F.lit(False))


def is_hash64(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-fA-F]{16}\z"), F.lit(False))


def hash_halves(hash64: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of 16 hex digits; a signed long can't hold all 64."""
    half = lambda at: F.conv(F.substring(hash64, at, 8), 16, 10).cast("long")
    return half(1), half(9)


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def group_id(least_sample_id: Column) -> Column:
    return F.concat(F.lit("split-"), F.substring(F.sha2(least_sample_id, 256), 1, 16))


def half_up_count(n: Column, fraction: float) -> Column:
    """A share of n, halves rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction)) + 0.5)).cast("long")


def resized(size: Column, scale: float) -> Column:
    """Halves round to even, as image sizes do here; at least one."""
    return F.greatest(F.lit(1), F.bround(size * F.lit(float(scale)), 0)).cast("long")


def blur_kernel_size(sigma: Column) -> Column:
    return (2 * F.ceil(3 * sigma) + 1).cast("long")


def correct_margin(logit: Column, label: Column) -> Column:
    return F.when(label == 1, logit).otherwise(-logit)


def composite(clean: Column, macro: Column) -> Column:
    return 0.5 * clean + 0.5 * macro


def learning_rate_factor(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), progress))))


def safe_relative_path(path: Column) -> Column:
    """Relative in POSIX and Windows terms, without a drive, a step up, or nothing at all."""
    bad = path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return path.isNotNull() & (stripped(path) != "") & ~bad


def html_escaped(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(vector_dot(a, b), F.sqrt(vector_dot(a, a)) * F.sqrt(vector_dot(b, b)))


def heading_section(markdown: Column, heading: str) -> Column:
    """The lines under ``## heading`` up to the next heading of that level; null without it."""
    at = F.split(F.concat(F.lit("\n"), markdown), rf"\n## {heading}\s*\n", 2)
    return F.when(F.size(at) == 2, F.element_at(F.split(F.element_at(at, 2), r"\n## ", 2), 1))


def normalized_filename_value(name: str) -> str:
    """Compatibility decomposition, case folded, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKD", name).casefold() if c.isalnum())


def html_escaped_value(text: str) -> str:
    return html.escape(text, quote=True)


#: Seeds of different uses differ by the domain; callers with seeds from elsewhere pass their own.
SEED_DOMAIN = b"siftwork-stable-seed-v1\0"


def stable_seed_value(*components: None | bool | int | float | str | bytes, domain: bytes = SEED_DOMAIN) -> int:
    """A 63-bit seed of typed components: tag, length and bytes of each, hashed with the domain.

    None, booleans, integers, finite floats, strings and bytes of equal spelling give different seeds.
    """
    body = [domain, len(components).to_bytes(8, "big")]
    for value in components:
        match value:
            case None:
                tag, raw = b"n", b""
            case bool():
                tag, raw = b"b", bytes([value])
            case int():
                tag, raw = b"i", b"%d" % value
            case float() if math.isfinite(value):
                tag, raw = b"f", struct.pack(">d", value)
            case str():
                tag, raw = b"s", value.encode()
            case bytes():
                tag, raw = b"y", value
            case _:
                raise ValueError(f"no seed from {value!r}")
        body += [tag, len(raw).to_bytes(8, "big"), raw]
    return int.from_bytes(hashlib.sha256(b"".join(body)).digest()[:8], "big") % 2**63


def stable_seed(*components: Column | int | str, domain: bytes = SEED_DOMAIN) -> Column:
    """``stable_seed_value`` as an expression: columns are taken as strings, Python values by their type."""
    head = (domain + len(components).to_bytes(8, "big")).hex()
    parts = [F.unhex(F.lit(head))]
    for value in components:
        if isinstance(value, Column):
            raw = F.encode(value.cast("string"), "utf-8")
            parts += [F.unhex(F.lit(b"s".hex())), F.unhex(F.lpad(F.hex(F.length(raw).cast("long")), 16, "0")), raw]
        else:
            tag, raw = (b"i", b"%d" % value) if isinstance(value, int) else (b"s", value.encode())
            parts.append(F.unhex(F.lit((tag + len(raw).to_bytes(8, "big") + raw).hex())))
    digest = F.sha2(F.concat(*parts), 256)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 32).bitwiseOR(low)
