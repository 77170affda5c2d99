"""URL expressions: safety codes, file names, content routing, image filters, refresh policy, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip


def parts(url: Column) -> dict[str, Column]:
    """Scheme, credentials, host, path and query of an absolute URL; empty where absent."""
    at = r"(?i)^([a-z][a-z0-9+.-]*):(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(:\d*)?)?([^?#]*)(\?[^#]*)?"
    get = lambda i: F.regexp_extract(url, at, i)
    return {"scheme": F.lower(get(1)), "credentials": get(2), "host": F.lower(get(3)), "path": get(5), "query": get(6)}


def _quad(host: Column) -> Column:
    """The dotted form of an IPv4 address mapped into IPv6, else the host without brackets."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    dotted = F.regexp_extract(bare, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    high, low = (F.conv(F.regexp_extract(bare, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i), 16, 10).cast("int") for i in (1, 2))
    words = F.concat_ws(".", F.shiftright(high, 8), high.bitwiseAND(255), F.shiftright(low, 8), low.bitwiseAND(255))
    return F.when(dotted != "", dotted).when(F.regexp_like(bare, F.lit(r"^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$")), words).otherwise(bare)


def is_loopback(host: Column) -> Column:
    h = _quad(F.lower(host))
    return (h == "::1") | F.startswith(h, F.lit("127."))


def is_link_local(host: Column) -> Column:
    h = _quad(F.lower(host))
    return F.startswith(h, F.lit("169.254.")) | F.regexp_like(h, F.lit("^fe[89ab][0-9a-f]:"))


def is_private(host: Column) -> Column:
    h = _quad(F.lower(host))
    return is_loopback(host) | F.regexp_like(h, F.lit(r"^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^f[cd][0-9a-f]{2}:|^169\.254\."))


def safety_code(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may be."""
    p = parts(url)
    host = p["host"]
    number = F.regexp_like(host, F.lit(r"^\d+$|(?:^|\.)0x[0-9a-f]+")) | (F.regexp_like(host, F.lit(r"(?:^|\.)0\d+")) & F.regexp_like(host, F.lit(r"^\d[\d.]*\d$")))
    return (
        F.when(url.isNull() | (p["scheme"] == ""), "url_parse")
        .when(~p["scheme"].isin("http", "https"), "url_scheme")
        .when(host == "", "url_parse")
        .when(p["credentials"] != "", "url_credentials")
        .when(number, "url_non_standard_ip")
        .when((host == "localhost") | F.endswith(host, F.lit(".localhost")), "url_localhost")
        .when(is_loopback(host), "url_loopback")
        .when(is_link_local(host), "url_link_local")
        .when(is_private(host), "url_private_ip")
    )


def file_name(url: Column, limit: int = 80) -> Column:
    """host-path.md; cut names and bare roots with a query get eight digits of the URL's SHA-256."""
    p = parts(url)
    path = F.coalesce(F.try_url_decode(F.regexp_replace(p["path"], r"\+", "%2B")), p["path"])
    slug = F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(?i)\.html?$", "")
    slug = F.regexp_replace(F.regexp_replace(slug, r"[^\p{L}\p{N}_./-]+", "-"), "/", "-")
    slug = F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-+|-+$", "")
    whole = F.concat(p["host"], F.lit("-"), F.when(slug == "", "root").otherwise(slug))
    bare = F.regexp_replace(F.regexp_replace(p["path"], "^/", ""), r"(?i)\.html?$", "") == ""
    hashed = (F.length(whole) > limit) | ((F.length(p["query"]) > 1) & bare)
    digits = F.left(F.sha2(url.cast("binary"), 256), F.lit(8))
    return F.concat(F.left(whole, F.lit(limit)), F.when(hashed, F.concat(F.lit("-"), digits)).otherwise(""), F.lit(".md"))


def content_route(content_type: Column, final_url: Column) -> Column:
    """html, pdf or reject."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    pdf_path = F.regexp_like(parts(final_url)["path"], F.lit(r"(?i)\.pdf$"))
    has = lambda s: F.contains(ct, F.lit(s))
    pdf = has("application/pdf") | has("application/x-pdf") | ((has("application/octet-stream") | (ct == "")) & pdf_path)
    return F.when(pdf, "pdf").when(has("text/html") | has("application/xhtml+xml"), "html").otherwise("reject")


def _no_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def absolute(src: Column, base: Column) -> Column:
    """An image or link address resolved against a page's URL, its port and . and .. segments included."""
    p = parts(base)
    origin = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(p["path"], "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    own, tail = F.regexp_extract(src, "^([^?#]*)", 1), F.regexp_extract(src, "^[^?#]*(.*)$", 1)
    inside = F.when(src == "", F.concat(p["path"], p["query"])).when(own == "", F.concat(p["path"], F.when(F.startswith(tail, F.lit("#")), p["query"]).otherwise(""), tail))
    inside = inside.otherwise(F.concat(_no_dots(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))), tail))
    return F.when(F.regexp_like(src, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), src).when(F.startswith(src, F.lit("//")), F.concat(p["scheme"], F.lit(":"), src)).otherwise(F.concat(origin, inside))


#: Image types kept, and their suffixes.
IMAGE_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp"}


def image_problem(src: Column, base: Column, content_type: Column, size: Column, truncated: Column, min_bytes: int = 200) -> Column:
    """Why an image isn't kept; null if it is."""
    p = parts(absolute(src, base))
    ct = strip(F.lower(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return (
        F.when(F.startswith(src, F.lit("data:")), "skip data: URI")
        .when(p["scheme"] == "", "skip invalid URL")
        .when(~p["scheme"].isin("http", "https"), "skip non-http URL")
        .when(p["host"].isin("", ".", "..") | F.regexp_like(p["host"], F.lit(r"[/\\\x00]")), "skip unsafe hostname")
        .when(truncated, "exceeded size cap")
        .when(ct.isin("image/svg+xml", "image/svg"), "SVG skipped")
        .when(~ct.isin(*IMAGE_TYPES), "unsupported MIME")
        .when(size < min_bytes, "small image")
    )


def fresh(stored_sha: Column, stored_policy: Column, fetched_at: Column, now: Column, refresh_days: int | None, strict: bool = False) -> Column:
    """Whether a stored page needn't be fetched again. refresh_days None: never again.

    A fetch time in the future counts as just now, hence fresh; strict makes it stale instead.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(fetched_at))
    age = F.when(age < 0, F.lit(None) if strict else F.lit(0)).otherwise(age)
    never = F.lit(refresh_days is None) | (F.coalesce(stored_policy, F.lit("")) == "never")
    within = F.coalesce(age < F.lit((refresh_days or 0) * 86400), F.lit(False))
    return (F.coalesce(stored_sha, F.lit("")) != "") & (never | within)


# ---- robots


def robots_rules(files: DataFrame, key: str = "host", text: str = "txt") -> DataFrame:
    """(key, agent, type, path) for each rule of each agent; consecutive agent lines share the rules after them.

    A group ends at the next agent line after a rule; agents without any rule in between join the next group.
    """
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "raw"))
    clean = strip(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select(key, "at", strip(F.lower(F.regexp_extract(clean, "^([^:]*):", 1))).alias("name"), strip(F.regexp_extract(clean, "(?s)^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("name").isin("user-agent", "allow", "disallow"))
    # one file is one row of input, so its lines are few enough for one window
    w = Window.partitionBy(key).orderBy("at")
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(w), F.lit("allow")) != "user-agent")
    lines = lines.withColumn("group", F.sum(starts.cast("int")).over(w))
    agents = lines.where("name = 'user-agent'").select(key, "group", F.lower("value").alias("agent"))
    rules = lines.where("name <> 'user-agent'").select(key, "group", F.col("name").alias("type"), F.col("value").alias("path"))
    return agents.join(rules, [key, "group"], "left").select(key, "agent", "type", "path")


def usable_robots(fetched: DataFrame, key: str = "host", text: str = "txt") -> DataFrame:
    """Robots files that count, of what was fetched (key, text, status, error): those read with 200; all else allows everything.

    An error other than not_found, server_error and fetch_failed is no answer: such hosts come with the text that forbids all.
    """
    fine = F.col("error").isNull() & (F.col("status") == 200)
    allows = F.col("error").isNull() | F.col("error").isin("not_found", "server_error", "fetch_failed")
    return fetched.where(fine | ~allows).select(key, F.when(fine, F.col(text)).otherwise("User-agent: *\nDisallow: /\n").alias(text))


def rule_pattern(path: Column) -> Column:
    """A robots path as a regular expression: * is anything, $ at the end is the end."""
    body = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(F.endswith(path, F.lit("$")), "$").otherwise(""))


def robots_allowed(probes: DataFrame, rules: DataFrame, key: str = "host", agent: str = "ua", path: str = "path", ignore: bool = False) -> DataFrame:
    """probes with the column allowed: the longest rule of the agent's own groups (else of *) decides, ties allow.

    No file, no group or no matching rule means allowed.
    """
    if ignore:
        return probes.withColumn("allowed", F.lit(True))
    own = rules.groupBy(key).agg(F.collect_set("agent").alias("agents"))
    asked = probes.select(key, agent, path).distinct().join(own, key, "left")
    asked = asked.withColumn("agent", F.when(F.array_contains("agents", F.lower(agent)), F.lower(agent)).otherwise("*")).drop("agents")
    used = rules.where("path is not null and path <> ''").withColumnRenamed("path", "rule")
    plain = ~F.contains("rule", F.lit("*")) & ~F.endswith("rule", F.lit("$"))
    fits = F.when(plain, F.startswith(path, "rule")).otherwise(F.regexp_like(path, rule_pattern(F.col("rule"))))
    best = asked.join(used, [key, "agent"]).where(fits).groupBy(key, agent, path).agg(F.max_by("type", F.struct(F.length("rule"), F.col("type") == "allow")).alias("type"))
    return probes.join(best, [key, agent, path], "left").withColumn("allowed", F.coalesce(F.col("type") == "allow", F.lit(True))).drop("type")
