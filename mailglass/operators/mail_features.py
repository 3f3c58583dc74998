"""Features of a mail in four scopes (mail, url, domain, attachment), as columns that rules are compiled against.

Input: mails of sources.mail.parse_mails, with `iocs` and `auth` of operators.mail_indicators. Python sees only what JVM
functions cannot say: texts beyond ASCII, references, archives and, for the few texts that need it, the surroundings of a
brand or a code.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions import values as V
from mailglass.functions.folding import by_batch, fold_each, unescape_each
from mailglass.functions.rules import quoted
from mailglass.functions.text import double_extension, invisible_obfuscation, leet, let, longest_run, lookalike, random_filename, same_owner, settled, site, terms, under_any, upper_ratio
from mailglass.operators import attachments as A
from mailglass.operators.mail_indicators import every, header, link_host
from mailglass.operators.mail_texts import hits_of, otp_notice, read_texts, with_brand_hits  # noqa: F401
from mailglass.rulebook import Rulebook

#: How HTML hides text, and elements with a style.
HIDING = r"(?:display\s*:\s*none|visibility\s*:\s*hidden|(?:max-)?height\s*:\s*0(?:px)?|width\s*:\s*0(?:px)?|font-size\s*:\s*(?:0|1)(?:px)?|opacity\s*:\s*0(?![\d.])|text-indent\s*:\s*-\d{2,}|mso-hide\s*:\s*all)"
#: A hidden element (its inside is group 2), else any other styled element as it stands (group 3), from left to right.
STYLED_ELEMENT = rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*?style\s*=\s*["'](?=[^"']*?{HIDING})[^"']*["'][^>]*?>(.*?)</\1\s*>|(<([a-z][a-z0-9]*)\b[^>]*?style\s*=\s*["'][^"']*["'][^>]*?>.*?</\4\s*>)"""
TAG, STYLE_BLOCK = r"<[^>]+>", r"(?is)<(?:style|script)\b[^>]*>.*?</(?:style|script)>"
#: Two noncharacters, which no text holds: hidden insides stand between them, and all of a page is read for them once. Only
#: pages with a hiding style are searched for its elements.
OPEN, SHUT = "\ufdd0", "\ufdd1"
MARKED = f"""case when _html rlike {quoted("(?i)" + HIDING)} then regexp_replace(translate(_html, '{OPEN}{SHUT}', ''), {quoted(STYLED_ELEMENT)}, '{OPEN}$2{SHUT}$3') else _html end"""
SHOWN = f"""regexp_replace(regexp_replace(regexp_replace(_marked, '(?s){OPEN}.*?{SHUT}', ''), {quoted(STYLE_BLOCK)}, ' '), '{TAG}', ' ')"""
ASSET = r"""(?i)(?:src|background)\s*=\s*["']?([^"'\s>]+)|url\(\s*["']?([^"')\s]+)"""
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
#: Mail programs that write their own name.
PROGRAMS = tuple("outlook foxmail thunderbird apple gmail microsoft smtp esmtp qq 163 coremail alimail swiftmailer phpmailer postfix sendmail exim mailagent easymail iphone ipad netease aliyun mime mailer webmail exchange lotus kmail mutt pine claws sylpheed".split())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(terms(words), lambda t: F.contains(text, t)) if words else F.lit(False)


def first_of(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def one_of(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_contains(terms(names), c) if names else F.lit(False)


# --- hosts and programs


def is_brand_host(host: Column, book: Rulebook) -> Column:
    """The registrable domain has a brand as a label, or is (or lies under) one of the brands' own hosts."""
    reg = F.when(site(host) != "", site(host)).otherwise(F.lower(host))
    plain = [b for b in book.terms["brands"] if "." not in b]
    return (host != "") & (F.arrays_overlap(F.split(reg, r"\."), terms(plain)) | under_any(reg, tuple(b for b in book.terms["brands"] if "." in b)))


def is_freemail(host: Column, book: Rulebook) -> Column:
    reg = F.when(site(host) != "", site(host)).otherwise(F.lower(host))
    return (host != "") & under_any(reg, book.terms["freemail"])


def junk_program(value: Column) -> Column:
    """Two or more capitalised words of 3 to 9 letters that name no known program."""
    words = F.filter(F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: w.rlike("^[A-Z].{2,8}$"))
    return ~any_of(F.lower(value), PROGRAMS) & (F.size(words) >= 2)


def split_base64(page: Column) -> Column:
    """Without comments the page has a longer run of base64 than with them."""
    dense = F.regexp_replace(page, r"(?U)\s+", "")
    run = r"[A-Za-z0-9+/=]{20,}"
    joined = lambda d: longest_run(F.regexp_replace(d, r"(?s)<!--.*?-->", ""), run)
    longer = let(dense, lambda d: let(joined(d), lambda j: (j >= 40) & (j > longest_run(d, run))))
    return F.when(F.contains(page, F.lit("<!--")), longer).otherwise(F.lit(False))


# --- links


def plain_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(url), r"[.,;:!?)）】]+$", ""), r"/+$", ""))


def unpacked(blob: str) -> str:
    """Base64 of a path, URL-safe or not, packed or plain; empty if it is none."""
    try:
        raw = base64.urlsafe_b64decode(blob.replace("+", "-") + "=" * (-len(blob) % 4))
    except ValueError:
        return ""
    try:
        return zlib.decompress(raw).decode("utf-8", "replace")
    except zlib.error:
        return raw.decode("utf-8", "replace")


def tracked(url: str) -> str:
    """What a tracking link carries in its path, in lower case."""
    return "\n".join(map(unpacked, re.findall(r"/([A-Za-z0-9_\-=]{40,}?)(?:\.html?|$)", url))).lower()


def shown_host(text: Column) -> Column:
    """The host of a URL, or a text that is nothing but a host name; empty for anything else."""
    bare = F.regexp_replace(F.lower(strip(text)), r"^\.+|\.+$", "")
    return F.when(link_host(strip(text)) != "", link_host(strip(text))).when(bare.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), bare).otherwise("")


def with_false_anchor(df: DataFrame, name: str, page: str, from_site: str, book: Rulebook) -> DataFrame:
    """df with `shown -> real` of the first link whose text names another party's host; null without one.

    Not meant are hosts under one another, allowed real hosts, and the sender's own name over a tracking link that carries it.
    """
    hrefs, texts = (F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.arrays_zip(hrefs.alias("h"), texts.alias("t")), lambda a: F.struct(a["h"].alias("href"), shown_host(F.regexp_replace(a["t"], TAG, "")).alias("shown"), shown_host(a["h"]).alias("real")))
    both = F.transform(F.filter(pairs, lambda p: (p["shown"] != "") & (p["real"] != "") & (p["shown"] != p["real"])), lambda p: F.struct(p["href"].alias("href"), p["shown"].alias("shown"), p["real"].alias("real"), site(p["shown"]).alias("seen"), site(p["real"]).alias("leads")))
    under = lambda p: p["shown"].endswith(F.concat(F.lit("."), p["real"])) | p["real"].endswith(F.concat(F.lit("."), p["shown"]))
    odd = F.filter(both, lambda p: (p["seen"] != p["leads"]) & ~under(p) & ~one_of(p["leads"], book.terms["link_allowlist"]))
    own = lambda p, me: (me != "") & (p["seen"] == me)
    x = df.withColumn("_odd", let(F.struct(F.col(from_site).alias("me"), odd.alias("odd")), lambda g: F.struct(g["me"].alias("me"), g["odd"].alias("odd"), F.exists(g["odd"], lambda p: own(p, g["me"])).alias("own"))))
    x = x.withColumn("_carried", by_batch(lambda hs: [tracked(h) for h in hs], "array<string>")(F.when(F.col("_odd.own"), F.transform("_odd.odd", lambda p: p["href"]))))

    def first(g: Column) -> Column:
        return first_of(g["odd"]["odd"], lambda p, i: ~(own(p, g["odd"]["me"]) & F.coalesce(F.contains(F.get(g["paths"], i), p["seen"]), F.lit(False))))

    x = x.withColumn("_first", let(F.struct(F.col("_odd").alias("odd"), F.col("_carried").alias("paths")), first))
    return x.withColumn(name, F.concat("_first.shown", F.lit(" -> "), "_first.real")).drop("_odd", "_carried", "_first")


# --- the whole record


def attachment_items(files: Column, found: Column) -> Column:
    """The attachment scope: files with what operators.attachments.inspect_all found in each."""
    seen = F.transform(files, lambda a, i: F.struct(a.alias("a"), F.get(found, i).alias("f"), A.real_type(a["content"]).alias("kind"), F.decode(a["content"], "ISO-8859-1").alias("text")))
    seen = F.transform(seen, lambda x: F.struct(x["a"].alias("a"), x["f"].alias("f"), x["kind"].alias("kind"), A.pdf_markers(x["text"]).alias("pdf"), A.families(x["a"]["content"], x["text"]).alias("rules")))

    def item(x: Column) -> Column:
        a, f, kind, pdf = x["a"], x["f"], x["kind"], x["pdf"]
        name, ext, mime = a["filename"], a["extension"], a["content_type"]
        no = lambda c: F.coalesce(c, F.lit(False))
        has = lambda k: no(F.array_contains(f["macros"], k))
        return F.struct(
            name.alias("filename"), F.lower(name).alias("filename_lower"), F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"(?s)^(.*)\.", 1)).otherwise(name).alias("stem"), ext.alias("extension"),
            mime.alias("content_type"), a["size"].alias("size"), kind.alias("real_type"), A.type_mismatch(kind, ext).alias("type_mismatch"), A.mime_conflict(mime, kind).alias("mime_type_conflict"),
            A.generic_mime(mime, ext).alias("generic_mime_known_ext"), double_extension(name).alias("double_ext"), A.bidi_name(name).alias("has_bidi_control"), F.length(name).alias("filename_length"),
            longest_run(name, " +").alias("max_space_run"), no(f["encrypted"]).alias("archive_encrypted"), (F.coalesce(f["password_used"], F.lit("")) != "").alias("archive_password_in_body"),
            no(f["has_executable"]).alias("archive_has_executable"), no(f["has_macro"]).alias("archive_has_macro"), F.coalesce(f["nested_depth"], F.lit(0)).alias("archive_nested_depth"),
            no(f["bomb_guard"]).alias("archive_bomb_guard"), no(f["office_macro"]).alias("office_has_macro"), has("autoexec").alias("office_macro_autoexec"), has("shell").alias("office_macro_shell"),
            has("download").alias("office_macro_download"), has("obfuscated").alias("office_macro_obfuscated"), F.coalesce(f["remote_template"], F.lit("")).alias("office_remote_template"), no(f["dde"]).alias("office_dde"),
            no(pdf["javascript"]).alias("pdf_javascript"), no(pdf["launch"]).alias("pdf_launch"), no(pdf["embedded"]).alias("pdf_embedded"), (F.size(x["rules"]) > 0).alias("yara_hit"), x["rules"].alias("yara_rules"),
            A.severity(x["rules"]).alias("yara_severity"),
        )

    return F.transform(seen, item)


def url_items(urls: Column) -> Column:
    seen = F.transform(urls, lambda u: F.struct(u.alias("url"), link_host(u).alias("host")))
    seen = F.transform(seen, lambda x: F.struct(x["url"].alias("url"), x["host"].alias("host"), F.filter(F.split(x["host"], r"\."), lambda p: p != "").alias("parts"), site(x["host"]).alias("site")))

    def item(x: Column) -> Column:
        below = F.size(x["parts"]) - F.when(F.get(x["parts"], F.lit(0)) == "www", 1).otherwise(0)
        n = F.when(x["site"] != "", F.greatest(below - F.size(F.split(x["site"], r"\.")), F.lit(0))).otherwise(below)
        return F.struct(x["url"].alias("url"), x["host"].alias("host"), F.coalesce(F.try_element_at(x["parts"], F.lit(-1)), F.lit("")).alias("tld"), n.alias("label_count"))

    return F.transform(seen, item)


def with_features(mails: DataFrame, book: Rulebook, exempt_lists: str = "0", exempt_freemail: bool = False) -> DataFrame:
    """mails with `mail` (a struct), `url`, `domain` and `attachment` (arrays of structs) and `found` (what the detectors
    that read one mail alone found). Null texts are empty. No shuffle.

    exempt_lists: "0", "1" (any list header) or "strict": mails of lists are not held to link only to their sender.
    """
    t = book.terms
    kept = [c for c in mails.columns if c not in ("mail", "url", "domain", "attachment", "found")]
    x = mails.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (("body_text", "_text"), ("body_html", "_html"))], header("from").alias("_raw_from"), header("subject").alias("_subject"))
    # The sender: display name, address, domain.
    angle = F.regexp_extract("_raw_from", "<([^>]+)>", 1)
    name = F.when(angle != "", F.regexp_extract("_raw_from", r"(?s)^(.*?)<[^>]+>", 1)).otherwise(F.col("_raw_from"))
    for edge in (r"(?U)^\s+|\s+$", '^"+|"+$', "^'+|'+$", r"(?U)^\s+|\s+$"):
        name = F.regexp_replace(name, edge, "")
    addr = F.lower(strip(F.when(angle != "", angle).otherwise(F.col("_raw_from"))))
    x = x.withColumns({"_name": name, "_addr": addr})
    x = x.withColumn("_domain", F.when(F.contains("_addr", F.lit("@")), strip(F.regexp_replace(F.substring_index("_addr", "@", -1), "^>+|>+$", ""))).otherwise(""))
    # Texts, folded once.
    shown, hidden = F.expr(SHOWN), F.array_join(F.filter(F.transform(F.regexp_extract_all("_marked", F.lit(f"(?s){OPEN}(.*?){SHUT}"), F.lit(1)), lambda h: strip(F.regexp_replace(h, TAG, ""))), lambda h: h != ""), " ")
    x = x.withColumn("_marked", F.expr(MARKED)).withColumns({"_visible": shown, "_hidden": hidden})
    given = {"text": "_text", "html": "_html", "visible": "_visible", "hidden": "_hidden", "subject": "_subject", "name": "_name", "domain": "_domain"}
    x = x.withColumn("_read", read_texts({k: F.col(c) for k, c in given.items()} | {"senders": every("from")}, book))
    x = x.withColumns({"_body": F.concat_ws("\n", "_read.text", "_read.html", "_read.plain"), "_seen": F.concat_ws("\n", "_read.text", "_read.visible"), "_fold_domain": F.col("_read.domain")})
    # Links: those that are not only pictures, by registrable domain.
    got = lambda i: F.regexp_extract_all("_html", F.lit(ASSET), F.lit(i))
    assets = F.filter(F.concat(got(1), got(2)), lambda a: a != "")
    x = x.withColumns({"_raw_assets": unescape_each(assets), "_urls": fold_each(F.col("iocs.urls")), "_site": site(F.col("_fold_domain"))})
    own = F.col("_site")

    def of_urls(given: Column) -> Column:
        hosts = F.transform(given["urls"], lambda u: F.struct(link_host(u).alias("host"), (~F.array_contains(given["pictures"], plain_url(u))).alias("click")))
        return F.transform(hosts, lambda h: F.struct(h["host"].alias("host"), site(h["host"]).alias("site"), h["click"].alias("click")))

    def of_links(u: Column) -> Column:
        clicked = F.filter(u, lambda h: h["click"])
        names = lambda a: F.transform(F.filter(a, lambda h: h["site"] != ""), lambda h: h["site"])
        return F.struct(F.array_intersect(names(u), names(clicked)).alias("links"), F.transform(clicked, lambda h: F.struct(h["host"].alias("host"), h["site"].alias("site"))).alias("clicked"))

    def of_sender(given: Column) -> Column:
        me, links = given["me"], let(of_urls(given), of_links)
        foreign = lambda l: F.filter(l["links"], lambda s: (me != "") & (s != me) & ~one_of(s, t["link_allowlist"]))
        public = lambda l: first_of(l["clicked"], lambda h: (h["host"] != "") & one_of(h["site"], t["user_content_hosting"]) & (h["host"] != h["site"]) & (h["host"] != F.concat(F.lit("www."), h["site"])) & ~((me != "") & (h["site"] == me)))
        other = lambda f: F.struct(first_of(f, lambda s: lookalike(s, me)).alias("alike"), first_of(f, lambda s: ~lookalike(s, me) & ~same_owner(s, me)).alias("other"))
        return let(links, lambda l: F.struct(l["links"].alias("links"), let(foreign(l), other).alias("foreign"), public(l)["host"].alias("hosted")))

    # Columns that Python makes must not stand in a lambda, so they are bound outside of all.
    x = settled(x, "_link", let(F.struct(own.alias("me"), F.transform("_raw_assets", plain_url).alias("pictures"), F.col("iocs.urls").alias("urls")), of_sender))
    x = with_false_anchor(x, "_anchor", "_html", "_site", book)
    in_list = lambda names: reduce(lambda a, b: a | b, (header(n) != "" for n in names))
    spared = F.lit(False)
    if exempt_lists in ("1", "true", "all"):
        spared = in_list(("list-unsubscribe", "list-id", "list-post"))
    elif exempt_lists == "strict":
        spared = in_list(("list-id", "list-post"))
    if exempt_freemail:
        spared = spared | one_of(own, t["freemail"])
    alike, other, hosted = F.col("_link.foreign.alike"), F.when(~spared, F.col("_link.foreign.other")), F.col("_link.hosted")
    back = F.lower(F.coalesce(F.col("auth.return_path_domain"), F.lit("")))
    senders = terms(t["esp_domains"])
    sent_by = lambda d: first_of(senders, lambda e: (d != "") & ((d == e) | d.endswith(F.concat(F.lit("."), e))))
    esp = [sent_by(F.col("_domain")), sent_by(back)]
    smtp = F.lower(F.coalesce(F.col("auth.smtp_mail_domain"), F.lit("")))
    party = lambda d: F.when(site(d) != "", site(d)).otherwise(d)
    bare = F.filter(F.col("iocs.domains"), lambda d: ~one_of(site(d), t["link_allowlist"]) & ~any_of(d, t["brands"]))
    # Attachments.
    secrets = F.concat_ws("\n", "_subject", F.substring("_text", 1, V.PASSWORD_TEXT), F.substring("_html", 1, V.PASSWORD_TEXT))
    x = x.withColumn("_found", A.inspect_all(F.col("attachments"), A.password_candidates(secrets)))
    x = x.withColumn("attachment", attachment_items(F.coalesce("attachments", F.array().cast(mails.schema["attachments"].dataType)), F.col("_found")))
    inline = F.coalesce(F.col("inline_images"), F.lit(0)) if "inline_images" in mails.columns else F.lit(0)
    x = x.withColumn("_images", F.size(F.filter("attachment", lambda a: a["content_type"].startswith("image/") | a["real_type"].isin("jpeg", "png", "gif"))) + inline)
    reply = F.lower(F.coalesce(F.col("auth.reply_to_domain"), F.lit("")))
    mail = F.struct(
        F.col("_read.subject").alias("subject"), F.col("_subject").alias("subject_raw"), letters(F.col("_subject")).alias("subject_letter_count"), upper_ratio(F.col("_subject")).alias("subject_upper_ratio"),
        F.col("_body").alias("body"), F.col("_html").alias("raw_html"), F.concat_ws("\n", "_read.subject", "_body").alias("text"), F.col("_seen").alias("visible_text"), F.array_join("_read.brands.seen", ",").alias("text_brand_hits"),
        F.col("_read.code").alias("otp_notice"), F.length(strip(F.col("_text"))).alias("body_text_length"), F.size("iocs.urls").alias("url_count"), F.size("attachment").alias("attachment_count"), F.col("_images").alias("image_count"),
        ((F.col("_images") > 0) & (F.col("_images") == F.size("attachment") + inline)).alias("image_only_attachments"),
        ((smtp != "") & (party(F.col("_domain")) != "") & (party(smtp) != party(F.col("_domain")))).alias("smtp_mail_mismatch"), F.contains("_body", F.lit("file:///")).alias("html_file_uri"),
        (header("list-unsubscribe") != "").alias("has_list_unsubscribe"), F.lower(strip(header("precedence"))).isin("bulk", "junk", "list").alias("precedence_bulk"), F.get("_read.hits", F.lit(0)).isNotNull().alias("has_unsubscribe_link"),
        F.coalesce(*esp, F.lit("")).alias("esp_domain"), junk_program(header("x-mailer")).alias("xmailer_junk"), F.size("iocs.domains").alias("domain_count"), F.size(bare).alias("brandless_domain_count"),
        F.col("_hidden").alias("hidden_html_text"), F.length("_hidden").alias("hidden_html_text_len"), ((F.size("_read.brands.hidden") > 0) & (F.size("_read.brands.seen") == 0)).alias("hidden_html_brand_mismatch"),
        split_base64(F.col("_html")).alias("html_comment_split_base64"), F.col("_link.links").alias("link_domains"), F.coalesce(F.concat(alike, F.lit(" ←→ "), own), F.lit("")).alias("link_domain_lookalike"),
        F.coalesce(F.concat(other, F.lit("（发件域 "), own, F.lit("）")), F.lit("")).alias("link_domain_mismatch"), F.coalesce(F.concat(hosted, F.lit("（"), site(hosted), F.lit("）")), F.lit("")).alias("user_content_link"),
        F.struct(
            F.col("_read.name").alias("display_name"), F.col("_addr").alias("addr"), F.array_join("_read.brands.name", ",").alias("display_brand"), F.col("_name").alias("display_name_raw"), letters(F.col("_name")).alias("display_letter_count"),
            upper_ratio(F.col("_name")).alias("display_upper_ratio"), F.size(F.filter(F.split("_name", r"(?U)\s+"), lambda w: w != "")).alias("display_word_count"), F.col("_domain").alias("domain"), own.alias("domain_reg"),
            is_brand_host(F.col("_fold_domain"), book).alias("domain_is_brand"), is_freemail(F.col("_fold_domain"), book).alias("is_freemail"), F.substring_index("_addr", "@", 1).alias("localpart"), leet(F.col("_domain")).alias("domain_leet"),
            every("from").alias("raw"),
        ).alias("from"),
        F.struct(reply.alias("domain"), site(reply).alias("domain_reg"), is_freemail(reply, book).alias("is_freemail")).alias("reply_to"),
        F.struct(back.alias("domain")).alias("return_path"),
        F.struct(*[F.coalesce(F.col(f"auth.{k}"), F.lit("")).alias(k) for k in ("spf", "dkim", "dmarc")], *[F.col(f"auth.{k}").alias(k) for k in ("has_auth_header", "reply_to_aligned", "return_path_aligned", "dmarc_without_mechanism")]).alias("auth"),
    )
    shown = F.transform(F.regexp_extract_all("_name", F.lit(r"(?U)[\w.+-]+@([A-Za-z0-9.-]*[A-Za-z])[A-Za-z0-9.-]*"), F.lit(1)), lambda d: F.regexp_replace(F.lower(d), r"^\.+|\.+$", ""))
    disguised = reduce(lambda a, b: a | b, (invisible_obfuscation(c) for c in (F.col("_subject"), F.col("_name"), F.substring("_text", 1, 2000))))
    found = F.struct(
        disguised.alias("text_invisible_obfuscation"),
        F.when(F.contains("_name", F.lit("@")) & (F.col("_domain") != "") & F.forall(shown, lambda d: d != F.col("_domain")), F.col("_domain")).alias("from_display_email_mismatch"),
        F.col("_anchor").alias("anchor_text_mismatch"),
        F.transform(F.filter("attachment", lambda a: (a["size"] > 0) & random_filename(a["stem"])), lambda a: a["filename"]).alias("att_random_name"),
        F.col("_read.html").alias("folded_html"),
        F.struct(F.col("_read.senders").alias("raw"), F.lower(F.col("_fold_domain")).alias("domain")).alias("folded_from"),
        F.transform("_urls", F.lower).alias("folded_urls"),
        F.col("_read.hits").alias(hits_of(book)),
    )
    domains = F.transform(F.col("iocs.domains"), lambda d: F.struct(d.alias("domain")))
    return x.select(*kept, mail.alias("mail"), url_items(F.col("iocs.urls")).alias("url"), domains.alias("domain"), "attachment", found.alias("found"))


