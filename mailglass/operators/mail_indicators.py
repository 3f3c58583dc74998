"""What a mail links to and names: URLs, domains, addresses' domains, IP addresses, hashes; and how it was authenticated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions.folding import refang
from mailglass.functions.text import let, private_ip, settled, site, under_any

#: How URLs, links, addresses and numbers are found, and what is cut from their ends.
URL = r"(?iU)\b(?:https?|ftp)://[^\s\"'<>{}\[\]|\\^`]+"
HREF = r"""(?iU)href\s*=\s*["']([^"']+)["']"""
ADDRESS_DOMAIN = r"(?U)[\w.+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
IPV4 = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"
SHA256, MD5 = r"(?U)\b[a-fA-F0-9]{64}\b", r"(?U)\b[a-fA-F0-9]{32}\b"
TAIL = r"[.,;:!?)）】]+$"
#: Hosts of name spaces, which no one visits.
STRUCTURAL = ("w3.org", "w3c.org", "ogp.me", "schema.org", "purl.org", "openxmlformats.org", "ns.adobe.com", "xmlsoap.org", "xmlns.com")
#: Results of authentication, and those that are clearly no pass.
RESULTS = ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "policy")
NOT_PASSED = ("fail", "softfail", "neutral", "none")


def header(name: str) -> Column:
    """The first value of a header; empty where the mail has none."""
    return F.coalesce(F.get(F.element_at("headers", F.lit(name)), F.lit(0)), F.lit(""))


def every(name: str) -> Column:
    """All values of a header in one text."""
    return F.coalesce(F.array_join(F.element_at("headers", F.lit(name)), " "), F.lit(""))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def host_part(url: Column) -> Column:
    """What stands between the scheme and the next : / ? or #, user included; in lower case."""
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1)


def link_host(url: Column) -> Column:
    return F.regexp_replace(host_part(url), r"^\.+|\.+$", "")


def with_indicators(mails: DataFrame) -> DataFrame:
    """mails with a struct `iocs`: urls, domains, header_domains, sender_domains, ips, private_ips, hashes; order of first
    sight, nothing twice (URLs regardless of case). Null texts are empty. No shuffle."""
    kept = [c for c in mails.columns if c != "iocs"]
    heads = ("from", "to", "cc", "reply-to", "return-path", "list-unsubscribe")
    given = F.struct(*[refang(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("body_text", "body_html")], *[refang(every(h)).alias(h) for h in heads], F.transform("attachments", lambda a: a["sha256"]).alias("files"))
    return settled(mails.select(*[F.col(f"`{c}`") for c in kept], given.alias("_given")), "iocs", let(F.col("_given"), _indicators)).drop("_given")


def _indicators(g: Column) -> Column:
    """The struct of indicators from refanged texts and headers; everything comes in by g, because a column that Python makes
    must not stand in a lambda."""
    texts = [g["body_text"], g["body_html"]]
    none = F.array().cast("array<string>")
    linked = lambda t: F.when(F.contains(t, F.lit("://")), F.transform(found(t, URL), lambda u: F.regexp_replace(u, TAIL, ""))).otherwise(none)
    hrefs = F.filter(found(g["body_html"], HREF, 1), lambda u: F.lower(u).rlike("^(http|ftp)"))
    every_url = F.transform(F.concat(*map(linked, texts), hrefs, *(linked(g[h]) for h in ("reply-to", "return-path", "list-unsubscribe"))), lambda u: F.regexp_replace(u, "/+$", ""))
    bare = lambda u: F.regexp_replace(F.regexp_replace(host_part(u), r"^[\[\]]+|[\[\]]+$", ""), r"^\.+|\.+$", "")
    outside = F.transform(F.filter(F.transform(every_url, lambda u: F.struct(u.alias("url"), bare(u).alias("host"))), lambda x: F.contains(x["host"], F.lit(".")) & ~under_any(x["host"], STRUCTURAL)), lambda x: x["url"])
    number = rf"^{IPV4[4:].replace(chr(92) + 'b', '')}$"
    addresses = F.concat(*(F.when(t.rlike(r"(?U)\d\.\d"), found(t, IPV4)).otherwise(none) for t in texts))
    # All of the long ones of both texts before the short ones makes no difference, as they are sorted.
    hashes = F.concat(*(F.when(t.rlike("[a-fA-F0-9]{32}"), F.concat(found(t, SHA256), found(t, MD5))).otherwise(none) for t in texts))
    senders = [F.transform(found(g[h], ADDRESS_DOMAIN, 1), F.lower) for h in ("from", "to", "cc", "reply-to", "return-path")]
    hosts = lambda u: F.transform(u, lambda x: F.regexp_replace(host_part(x), r"^[._-]+|[._-]+$", ""))

    def lists(u: Column) -> Column:
        ips = F.array_distinct(F.concat(F.filter(u["hosts"], lambda h: h.rlike(number)), addresses))
        return let(
            ips,
            lambda i: F.struct(
                u["urls"].alias("urls"),
                F.array_distinct(F.filter(u["hosts"], lambda h: F.contains(h, F.lit(".")) & ~h.rlike(number))).alias("domains"),
                F.array_distinct(F.concat(*senders)).alias("header_domains"),
                F.array_distinct(F.concat(senders[0], senders[3], senders[4])).alias("sender_domains"),
                F.filter(i, lambda v: ~private_ip(v)).alias("ips"),
                F.filter(i, private_ip).alias("private_ips"),
                F.array_distinct(F.concat(F.array_sort(F.array_distinct(F.transform(hashes, F.lower))), g["files"])).alias("hashes"),
            ),
        )

    return let(let(first_spellings(outside), lambda u: F.struct(u.alias("urls"), hosts(u).alias("hosts"))), lists)


def first_spellings(texts: Column) -> Column:
    """Texts that differ in more than case, each as it stands first, in order of first sight."""
    told = F.array_sort(F.transform(texts, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("at"), t.alias("text"))))
    first = let(told, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["low"] != x["low"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text")))), lambda x: x["text"])


def ioc_count(iocs: str = "iocs") -> Column:
    """Indicators of a mail; private addresses and sender domains, which others contain, do not count."""
    return sum((F.size(f"{iocs}.{k}") for k in ("urls", "domains", "header_domains", "ips", "hashes")), F.lit(0))


# --- authentication


def stated(head: Column, method: str) -> Column:
    """A method's result in one header: pass if any is, else the first valid one; null without one."""
    got = F.filter(F.regexp_extract_all(F.lower(head), F.lit(rf"(?<![a-z0-9-]){method}\s*=\s*([a-z]+)"), F.lit(1)), lambda r: r.isin(*RESULTS))
    return F.when(F.array_contains(got, "pass"), "pass").otherwise(F.get(got, F.lit(0)))


def merged(heads: Column, method: str) -> Column:
    """Over all headers: pass if any says so, else what the last one says."""
    got = F.filter(F.transform(heads, lambda h: stated(h, method)), lambda r: r.isNotNull())
    return F.when(F.array_contains(got, "pass"), "pass").when(F.size(got) > 0, F.element_at(got, -1))


def address_domain(text: Column) -> Column:
    """The domain of the first address in a refanged header, else a single label behind an @; null without one."""
    strict = F.regexp_extract(text, r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)
    loose = F.regexp_extract(text, r"@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)", 1)
    return F.lower(F.when(strict != "", strict).when(loose != "", loose))


def with_authentication(mails: DataFrame) -> DataFrame:
    """mails with a struct `auth`: results, their contradiction, the domains of sender and replies and whether they agree."""
    heads = F.coalesce("auth_results", F.array().cast("array<string>"))
    mail_from = r"(?i)smtp\.mail(?:from)?\s*[=<]\s*<?\s*[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+)"
    x = mails.withColumns({f"_{h}": address_domain(refang(header(h))) for h in ("from", "reply-to", "return-path")})
    own, reply, back = F.col("_from"), F.col("`_reply-to`"), F.col("`_return-path`")
    party = lambda d: F.when(site(d) != "", site(d)).otherwise(d)
    smtp = F.get(F.filter(F.transform(heads, lambda h: F.lower(F.regexp_extract(h, mail_from, 1))), lambda d: d != ""), F.lit(0))
    odd = F.exists(heads, lambda h: F.coalesce((stated(h, "dmarc") == "pass") & stated(h, "spf").isin(*NOT_PASSED) & stated(h, "dkim").isin(*NOT_PASSED), F.lit(False)))
    auth = F.struct(
        *[merged(heads, m).alias(m) for m in ("spf", "dkim", "dmarc")],
        (F.size(heads) > 0).alias("has_auth_header"),
        odd.alias("dmarc_without_mechanism"),
        own.alias("from_domain"),
        back.alias("return_path_domain"),
        reply.alias("reply_to_domain"),
        smtp.alias("smtp_mail_domain"),
        F.coalesce(back == own, F.lit(True)).alias("return_path_aligned"),
        F.coalesce(party(reply) == party(own), F.lit(True)).alias("reply_to_aligned"),
    )
    return x.select(*[F.col(f"`{c}`") for c in mails.columns if c != "auth"], auth.alias("auth"))
