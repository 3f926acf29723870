"""Extraction of people, organisations, addresses, events and requests from ticket texts, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from . import pack_zh as zh
from .containment import contained
from .dates import extract_time
from .rules import by_script, count_words, first_label, leftmost_term, longest_term, most_words
from .text import CJK, any_of, blank, clean_phone, clean_text, clean_ticket_no, content_hash, extract_phone, filled, first_filled, first_found, has_any, has_chinese, holds_any, let, normalize_address, normalize_text, remove_boilerplate, semantic_content, strip

NO_ADDRESS = "struct<town:string,community:string,road:string,building:string>"


def match_event(title: Column, content: Column, terms: Sequence[str]) -> Column:
    """Longest term of the title, else of the content."""
    return first_found(longest_term(title, terms), longest_term(content, terms))


def match_area(area: Column, content: Column, title: Column, terms: Sequence[str] = tuple(zh.TOWNS)) -> Column:
    """Area of the field, the content or the title: a listed one, else a name before 街道 or 镇."""

    def found(c: Column) -> Column:
        general = lambda x: F.regexp_replace(F.regexp_extract(x, f"([{CJK}]{{1,4}}(?:街道|镇))", 1), "^.*?[区市县]", "")
        # the terms' places are only asked for if there is one
        return let(c, lambda x: first_found(F.when(holds_any(x, terms), leftmost_term(x, terms)), F.when(has_chinese(x), general(x))))

    return first_found(found(area), found(content), found(title))


def _first_valid(c: Column, patterns: Sequence[str], valid) -> Column:
    """First valid match of the first pattern that has one, as the pattern's group 1; else null."""
    return F.coalesce(*[F.get(F.filter(F.regexp_extract_all(c, F.lit(p), F.lit(1)), valid), 0) for p in patterns])


def _name(longest: int, suffixes: str) -> str:
    return f"([{CJK}]{{2,{longest}}}(?:{suffixes}))"


def extract_subject(c: Column, blacklist: Sequence[str] = tuple(zh.SUBJECT_BLACKLIST)) -> Column:
    """First name that isn't blacklisted: community, then institution, company, shop or place."""
    names = [_name(n, s) for n, s in zh.SUBJECTS]
    return F.coalesce(_first_valid(c, names, lambda x: ~has_any(x, blacklist)), F.lit(""))


def subject_pipeline(title: Column, raw: Column, content: Column) -> Column:
    return first_found(extract_subject(title), extract_subject(raw), extract_subject(content))


def extract_person(c: Column) -> Column:
    """struct<name, confidence>: a surname with a title, 某 names, else a name after 市民 or 诉求人."""
    name = first_found(*[F.regexp_extract(c, p, 0) for p in zh.PERSONS])
    return let(name, lambda n: F.struct(n.alias("name"), F.when(n != "", 0.6).otherwise(0.0).alias("confidence")))


def valid_organisation(x: Column) -> Column:
    """At least two different signs, no word that belongs to a sentence, no such beginning, not blacklisted."""
    return (
        (F.length(x) >= 2)
        & ~has_any(x, zh.NAME_MUST_NOT_HOLD)
        & ~x.rlike(f"^(?:{any_of(zh.NAME_MUST_NOT_BEGIN)})")
        & ~x.rlike(r"^(.)\1*$")
        & ~has_any(x, zh.SUBJECT_BLACKLIST)
    )


def labour_company(c: Column) -> Column:
    """Company of a text about wages, else null."""
    valid = lambda x: valid_organisation(x) & ~x.rlike(f"(?:{any_of(zh.GENERIC_SUFFIX)})$") & ~has_any(x, zh.LABOUR_NAME_MUST_NOT_HOLD)
    return F.when(has_chinese(c) & has_any(c, zh.LABOUR_WORDS), _first_valid(c, zh.LABOUR_COMPANIES, valid))


def extract_organization(c: Column) -> Column:
    """struct<name, kind, confidence>: a company in texts about wages, else the first valid name of the first kind."""
    return let(c, lambda x: F.when(has_chinese(x), _organization(x)).otherwise(_no_organization()))


def _no_organization() -> Column:
    return F.struct(F.lit("").alias("name"), F.lit("").alias("kind"), F.lit(0.0).alias("confidence"))


def _organization(c: Column) -> Column:
    named = lambda name, kind, sure: let(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))))
    kinds = [named(_first_valid(c, [_name(n, s)], valid_organisation), kind, 0.7) for kind, n, s in zh.ORGANISATIONS]
    return F.coalesce(named(labour_company(c), "企业", 0.9), *kinds, _no_organization())


def resolve_organization(title: Column, content: Column, community: Column, address: Column) -> Column:
    """Organisation of the title, a company in the content, the address's community, the address, else the whole text."""
    named = lambda name, kind, sure: F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    some = lambda found: let(found, lambda x: F.when(x["name"] != "", x))
    company = let(labour_company(content), lambda x: F.when(x.isNotNull(), named(x, "企业", 0.9)))
    place = F.when((community != "") & ~has_any(community, zh.SUBJECT_BLACKLIST), named(community, "小区", 0.85))
    return F.coalesce(some(extract_organization(title)), company, place, some(extract_organization(address)), extract_organization(content))


def pick_subject(resolved: Column, title: Column, raw: Column) -> Column:
    return first_found(resolved, extract_organization(title)["name"], extract_organization(raw)["name"])


def _without_lead(c: Column) -> Column:
    """Without leading words that no address begins with, taken off again and again."""
    return F.regexp_replace(c, f"^(?:{any_of(zh.ADDRESS_LEAD)})+", "")


def _valid_community(x: Column) -> Column:
    alone = x.isin("社区", "村", "新城", "新村") | x.rlike("^(?:小区|花园|公寓|苑|居|府|城|村|社区)$") | x.rlike("^.(?:社区|村|城)$")
    return (F.length(x) >= 2) & ~alone & ~has_any(x, zh.ADDRESS_MUST_NOT_HOLD) & ~x.rlike("^[是其该此于在的了]")


def extract_address(c: Column, gazetteer: dict[str, Sequence[str]] | None = None) -> Column:
    """struct<district, town, community, road, building, address_raw>.

    The town is the first listed one; its community is the first of the gazetteer
    (town to names) after it, else the name before the first bracket, else a
    name after the town, else any. The road follows the town.
    """
    stems = "|".join(t.removesuffix("街道").removesuffix("镇") for t in zh.TOWNS)
    found = lambda x: let(F.regexp_extract(x, f"((?:{stems})(?:街道|镇)?)", 1), lambda said: _address(x, said, gazetteer))
    none = F.struct(F.lit(zh.DISTRICT).alias("district"), *[F.lit("").alias(k) for k in ("town", "community", "road", "building", "address_raw")])
    return let(c, lambda x: F.when(has_chinese(x), found(x)).otherwise(none))


def _address(c: Column, said: Column, gazetteer: dict[str, Sequence[str]] | None) -> Column:
    town = F.coalesce(*[F.when(said.startswith(t.removesuffix("街道").removesuffix("镇")), t) for t in zh.TOWNS], F.lit(""))
    rest = F.when(said == "", c).otherwise(F.substr(c, F.instr(c, said) + F.length(said)))
    return let(F.struct(town.alias("town"), rest.alias("rest")), lambda x: _address_after(c, said, x["town"], x["rest"], gazetteer))


def _address_after(c: Column, said: Column, town: Column, rest: Column, gazetteer: dict[str, Sequence[str]] | None) -> Column:
    listed = F.coalesce(*[F.when((town == t) & F.contains(rest, F.lit(name)), name) for t, names in (gazetteer or {}).items() for name in names], F.lit(""))
    lead = F.when(c.rlike("[（(]"), _without_lead(F.regexp_extract(c, r"^([^（(]*)[（(]", 1)))
    bracket = F.regexp_extract(lead, f"([{CJK}A-Za-z0-9]{{1,6}}(?:{any_of(zh.ESTATE_SUFFIXES)}))$", 1)
    bracket = let(bracket, lambda x: F.when((F.length(x) >= 3) & _valid_community(x), x))
    name = rf"(?<![电反映称示位有没不未])([{CJK}A-Za-z0-9]{{2,8}}?(?:小区|花园|公寓|府|村|社区|苑))"

    def general(x: Column) -> Column:
        names = F.transform(F.regexp_extract_all(x, F.lit(name), F.lit(1)), _without_lead)
        return F.get(F.filter(names, _valid_community), 0)

    community = first_found(listed, bracket, general(rest), F.when(said != "", general(c)))
    roads = F.transform(F.regexp_extract_all(rest, F.lit(f"([{CJK}]{{2,8}}?(?:路|街|大道|巷|公路))"), F.lit(1)), _without_lead)
    road = F.coalesce(F.get(F.filter(roads, lambda r: (F.length(r) >= 2) & ~has_any(r, zh.ADDRESS_MUST_NOT_HOLD)), 0), F.lit(""))
    unit = "(?:栋|幢|座|单元|号|室|层|楼)"
    building = F.regexp_extract(c, rf"(\d+{unit}(?:\d*{unit})*)", 1)
    piece = F.when(said != "", strip(F.regexp_extract(F.substr(c, F.instr(c, said), F.lit(30)), r"^[^。，；！？\n(（]*", 0)))

    def whole(x: Column) -> Column:
        parts = [x[k] for k in ("community", "road", "building")]
        return F.struct(F.lit(zh.DISTRICT).alias("district"), town.alias("town"), *[p.alias(k) for p, k in zip(parts, ("community", "road", "building"), strict=True)], first_found(normalize_address(town, *parts), piece).alias("address_raw"))

    return let(F.struct(community.alias("community"), road.alias("road"), building.alias("building")), whole)


def classify_event_type(title: Column, content: Column, rules: Sequence[tuple[str, str | Sequence[str]]] = tuple(zh.EVENT_TYPES)) -> Column:
    every_chinese = all(re.search(f"[{CJK}]", w) for _, words in rules for w in ([words] if isinstance(words, str) else words))
    guard = has_chinese if every_chinese else lambda x: F.lit(True)
    return let(F.concat_ws(" ", title, content), lambda x: F.when(guard(x), first_label(x, rules)).otherwise(""))


def event_action(kind: Column, content: Column) -> Column:
    """What happened, by event type and keywords; '' for types without a rule."""

    def action(x: Column) -> Column:
        out = F.lit("")
        for label, (rules, otherwise) in zh.EVENT_ACTIONS.items():
            out = F.when(x["kind"] == label, first_label(x["text"], [(action, words) for words, action in rules], otherwise)).otherwise(out)
        return out

    return let(F.struct(kind.alias("kind"), content.alias("text")), action)


def event_detail(address: Column, subject: Column, action: Column, content: Column) -> Column:
    return first_filled(F.concat(address, subject, action), F.substring(content, 1, 60))


def classify_channel(c: Column, online: Sequence[str] = tuple(zh.ONLINE_WORDS), offline: Sequence[str] = tuple(zh.OFFLINE_WORDS)) -> Column:
    """online or offline by the larger number of words, offline if equal, unknown without any."""
    counts = let(c, lambda x: by_script(x, [online, offline], lambda lists: F.struct(*[count_words(x, words).alias(n) for n, words in zip("ab", lists, strict=True)])))
    return let(counts, lambda n: F.when((n["a"] == 0) & (n["b"] == 0), "unknown").when(n["a"] > n["b"], "online").otherwise("offline"))


def classify_nature(c: Column, rules: Sequence[tuple[str, Sequence[str]]] = tuple(zh.NATURES)) -> Column:
    return let(c, lambda x: most_words(x, rules))


def extract_request(c: Column, kind: Column, rules: Sequence[tuple[str, str | Sequence[str]]] = tuple(zh.REQUESTS), verbs: Sequence[str] = tuple(zh.REQUEST_VERBS), fallback: tuple[Sequence[str], str] = zh.REQUEST_FALLBACK) -> Column:
    """struct<request, issue>: the first request with a keyword; the issue is it without verbs, else the event type."""
    patterns = any(isinstance(words, str) for _, words in rules)

    def found(x: Column) -> Column:
        labels = lambda lists: first_label(x, [(label, words) for (label, _), words in zip(rules, lists, strict=True)])
        return first_label(x, rules) if patterns else by_script(x, [words for _, words in rules], labels)

    of = lambda x: F.struct(x["text"].alias("text"), found(x["text"]).alias("found"), x["kind"].alias("kind"))
    return let(let(F.struct(c.alias("text"), kind.alias("kind")), of), lambda x: _request(x["text"], x["found"], x["kind"], verbs, fallback))


def _request(c: Column, found: Column, kind: Column, verbs: Sequence[str], fallback: tuple[Sequence[str], str]) -> Column:
    request = F.when(found != "", found).when(by_script(c, [fallback[0]], lambda lists: has_any(c, lists[0]) if lists[0] else F.lit(False)), fallback[1]).otherwise("")
    issue = found
    for verb in verbs:
        issue = F.replace(issue, F.lit(verb), F.lit(""))
    return F.struct(request.alias("request"), F.when(c == "", "").otherwise(first_filled(issue, kind)).alias("issue"))


def quality_score(no: Column, content: Column, time: Column, organisation: Column, address: Column, event: Column, min_quality: float = 0.3) -> Column:
    """struct<score, usable, status>; parts are added as whole hundredths."""
    parts = ((no, 15), (content, 20), (time, 10), (organisation, 20), (address, 20), (event, 15))
    total = sum((F.when(F.coalesce(c, F.lit("")) != "", n).otherwise(0) for c, n in parts), F.lit(0))
    usable = (total >= round(100 * min_quality)) & (no != "") & (content != "")
    status = F.when((no == "") | (content == ""), "failed").when(total < round(100 * min_quality), "partial").otherwise("success")
    return F.struct((total / 100).alias("score"), usable.alias("usable"), status.alias("status"))


def _venue_pattern(suffix: str) -> str:
    """Up to eight signs before the suffix that are no boundary, so that a match's name is as long as the scan to the left allows."""
    return f"([{CJK}&&[^{zh.VENUE_BOUNDARY}]]{{2,8}}{suffix})"


def extract_venues(c: Column) -> Column:
    """Names of two to eight signs with a venue's suffix, suffixes in order, each by place.

    A name that itself ends in its suffix's occurrence is found for every
    occurrence: the text is cut after each one.
    """

    def of(suffix: str) -> Column:
        ends = F.split(c, suffix, -1)
        heads = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.concat(F.array_join(F.slice(ends, F.lit(1), i), suffix), F.lit(suffix)))
        names = F.transform(heads, lambda h: F.regexp_extract(h, _venue_pattern(suffix) + "$", 1))
        return F.when(F.size(ends) > 1, F.filter(names, lambda x: x != "")).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(s) for s in zh.VENUE_SUFFIXES]))


def best_venue(c: Column) -> Column:
    """The shortest venue, of equals the first."""
    shortest = lambda venues: F.get(F.filter(venues, lambda v: F.length(v) == F.array_min(F.transform(venues, F.length))), 0)
    return F.coalesce(let(extract_venues(c), shortest), F.lit(""))


def clean_tickets(df: DataFrame, gazetteer: dict[str, Sequence[str]] | None = None, min_quality: float = 0.3) -> DataFrame:
    """All cleaned fields of tickets (ticket_no, title, content, caller_phone, _seq): one projection, no shuffle.

    An address that has only the district counts as blank. Extraction reads the
    content as given; the cleaned text is kept beside it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    phone = lambda: F.when(clean_phone(text("caller_phone"))["confidence"] > 0, clean_phone(text("caller_phone"))).otherwise(extract_phone(text("content")))
    df = df.select(
        clean_ticket_no(text("ticket_no")).alias("ticket_no"), text("title").alias("title"), text("content").alias("raw_content"), F.col("_seq"),
        content_hash(text("ticket_no"), text("content"), text("title")).alias("content_hash"), phone().alias("phone"),
        clean_text(text("content")).alias("clean_content"), extract_address(text("content"), gazetteer).alias("address"),
        extract_person(text("content")).alias("person"), extract_time(text("content")).alias("time"),
        classify_event_type(text("title"), text("content")).alias("event_type"),
        classify_channel(text("content")).alias("channel"), classify_nature(text("content")).alias("nature"),
    )
    address = F.col("address")
    df = df.withColumns(
        {
            "address_normalized": normalize_address(address["town"], address["community"], address["road"], address["building"]),
            "organization": resolve_organization(F.col("title"), F.col("raw_content"), address["community"], address["address_raw"]),
            "event_action": event_action(F.col("event_type"), F.col("raw_content")),
            "request": extract_request(F.col("raw_content"), F.col("event_type")),
        }
    )
    df = df.withColumn("event_detail", event_detail(address["address_raw"], F.col("organization")["name"], F.col("event_action"), F.col("raw_content")))
    meaning = semantic_content(F.col("organization")["name"], F.col("address_normalized"), F.col("event_type"), F.col("event_detail"), F.col("request")["request"], F.col("time")["start"], F.col("time")["pattern"])
    quality = quality_score(F.col("ticket_no"), F.col("raw_content"), first_filled(F.col("time")["start"], F.col("time")["pattern"]), F.col("organization")["name"], F.col("address_normalized"), F.col("event_type"), min_quality)
    return df.withColumns({"semantic_content": first_filled(meaning, F.substring(remove_boilerplate(F.col("clean_content")), 1, 200)), "quality": quality})


def standardize_tickets(df: DataFrame, synonyms: Sequence[tuple[str, str]], events: Sequence[str], areas: Sequence[str] = tuple(zh.TOWNS)) -> DataFrame:
    """The older projection: normalised content and title, and a subject, event and area of each ticket."""
    df = df.withColumns({f"normalized_{c}": normalize_text(F.coalesce(F.col(c), F.lit("")), synonyms) for c in ("content", "title")})
    content, title = F.col("normalized_content"), F.col("normalized_title")
    return df.withColumns(
        {
            "extracted_subject": subject_pipeline(title, F.coalesce(F.col("subject"), F.lit("")), content),
            "extracted_event": match_event(title, content, events),
            "extracted_area": match_area(F.coalesce(F.col("area"), F.lit("")), content, title, areas),
        }
    )


def to_pipeline_columns(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """Cleaned fields under the names that grouping reads, on the tickets (order_id = ticket_no)."""
    c = cleaned.select(
        F.col("ticket_no").alias("order_id"),
        first_filled(F.col("semantic_content"), F.col("clean_content"), F.col("raw_content")).alias("normalized_content"),
        F.col("organization")["name"].alias("__org"), F.col("event_type").alias("extracted_event"), F.col("address")["town"].alias("__town"),
        F.col("address_normalized").alias("addr_norm"), F.col("address")["community"].alias("addr_community"), F.col("address")["building"].alias("addr_building"),
    )
    out = raw.join(c, "order_id")
    return out.withColumns({"extracted_subject": pick_subject(F.col("__org"), F.col("title"), F.col("subject")), "extracted_area": first_filled(F.col("__town"), blank(F.col("area")))}).drop("__org", "__town")


def held_names(names: DataFrame, aliases: DataFrame, min_length: int = 3) -> DataFrame:
    """Pairs (name, alias) of different names and aliases of which one, of at least min_length signs, is in the other."""
    named = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text")).distinct()
    wanted = lambda df, c: df.where(F.length(c) >= min_length).select(F.col(c).alias("name"))
    inside = contained(named(names, "name"), wanted(aliases, "alias"))
    around = contained(named(aliases, "alias"), wanted(names, "name"))
    return inside.select(F.col("id").alias("name"), F.col("name").alias("alias")).union(around.select("name", F.col("id").alias("alias"))).distinct()


def normalize_entity(df: DataFrame, key: str, name: str, aliases: DataFrame, min_length: int = 3) -> DataFrame:
    """Add canonical and confidence by aliases (canonical, alias): equal names first, then names that hold one another.

    The canonical name itself scores 1.0, another alias 0.9; containment either
    way, by names of at least min_length, takes the first (canonical, alias) and
    scores 0.7; others keep their name at 0.3, empty ones at 0. Different names
    and aliases meet through an index of rare parts (containment.contained), so either table may be large.
    """
    exact = aliases.groupBy(F.col("alias").alias(name)).agg(F.min("canonical").alias("__c"))
    hit = df.join(exact, name, "left")
    # read four times, so worked out once
    misses = written(hit.where(F.col("__c").isNull() & filled(F.col(name)).isNotNull()).select(F.col(name).alias("name")).distinct())
    first = aliases.where(F.col("canonical").isNotNull()).groupBy("alias").agg(F.min("canonical").alias("canonical"))
    near = held_names(misses, first, min_length).join(first, "alias")
    fuzzy = near.groupBy(F.col("name").alias(name)).agg(F.min_by("canonical", F.struct("canonical", "alias")).alias("__f"))
    out = hit.join(fuzzy, name, "left")
    sure = F.when(F.col("__c") == F.col(name), 1.0).when(F.col("__c").isNotNull(), 0.9).when(F.col("__f").isNotNull(), 0.7).when(filled(F.col(name)).isNotNull(), 0.3).otherwise(0.0)
    return out.withColumns({"canonical": F.coalesce("__c", "__f", F.col(name), F.lit("")), "confidence": sure}).drop("__c", "__f")


def verify_entities(df: DataFrame, name: str, poi: DataFrame) -> DataFrame:
    """Add verified: whether the name is in a table of places (name)."""
    known = poi.select(F.col("name").alias(name), F.lit(True).alias("verified")).distinct()
    return df.join(known, name, "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


VERDICT = "valid boolean, normalized_name string, entity_type string, confidence double"


def resolve_with_reference(df: DataFrame, name: str, poi: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add entity struct<name, kind, confidence>: a known place, else a valid verdict (name, payload JSON), else the name as it is."""
    known = poi.select(F.col("name").alias(name), F.lit(True).alias("__poi")).distinct()
    said = verdicts.groupBy(F.col("name").alias(name)).agg(F.max("payload").alias("__p")).withColumn("__v", F.from_json("__p", VERDICT)).drop("__p")
    out = df.join(known, name, "left").join(said, name, "left")
    make = lambda n, kind, sure: F.struct(n.alias("name"), kind.alias("kind"), sure.alias("confidence"))
    v = F.col("__v")
    entity = (
        F.when(F.col("__poi"), make(F.col(name), F.lit("企业"), F.lit(0.9)))
        .when(v["valid"], make(F.coalesce(v["normalized_name"], F.col(name)), F.coalesce(v["entity_type"], F.lit("未知")), F.coalesce(v["confidence"], F.lit(0.5))))
        .otherwise(make(F.col(name), F.lit("未知"), F.lit(0.3)))
    )
    return out.withColumn("entity", entity).drop("__poi", "__v")


def override_from_verdicts(df: DataFrame, key: str, verdicts: DataFrame) -> DataFrame:
    """Add event_type, request and issue from verdicts (key, payload JSON), with confidence; bad JSON gives '' and 0."""
    said = verdicts.select(key, F.from_json("payload", "event_type string, request string, issue string, confidence double").alias("__v"))
    v = F.col("__v")
    return df.join(said, key, "left").withColumns({**{c: F.coalesce(v[c], F.lit("")) for c in ("event_type", "request", "issue")}, "confidence": F.coalesce(v["confidence"], F.lit(0.0))}).drop("__v")
