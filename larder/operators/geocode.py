"""Shop addresses placed from landed map hits: parse, ask, combine, match, decide. Never guesses.

A map answer holds at most 80 hits (two request shapes of 40), so a shop's hits stay in its own row as arrays. The whole
decision is one projection over shops after two joins on the question's text; no pairs of shops are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions.geo import box_diagonal_m, box_gap_m, in_country
from larder.functions.money import lookup
from larder.functions.text import fold, fold_to, html_to_text, let, squeeze
from larder.schemas import OSM_HIT

_CROSS_TYPE = {"calle": "carrera", "diagonal": "carrera", "carrera": "calle", "transversal": "calle"}


_STREET_RE = rf"^{fixed.STREET_NUMBER}(?:\s+(sur|este))?"


_SIGNS = dict.fromkeys("–—", "-") | dict.fromkeys("°º\"“”'.,", " ")


def clean(col: Column) -> Column:
    """Folded text with one kind of dash, no punctuation, and ``#`` standing alone."""
    return squeeze(F.replace(fold_to(col, _SIGNS), F.lit("#"), F.lit(" # ")))


def _groups(text: Column, pattern: str, count: int) -> Column:
    """Whole match and captured groups of the first match as an array, by two passes; null entries for no match."""
    marks = "\u0001".join(f"${i}" for i in range(count + 1))
    return F.split(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, marks), "\u0001", -1)


def _group(groups: Column, index: int) -> Column:
    return F.nullif(F.get(groups, F.lit(index)), F.lit(""))


def _number_of(groups: Column) -> Column:
    """Digits, letter, bis and second letter of a street number, run together."""
    return F.array_join(F.slice(groups, 2, 4), "")


def _opening(text: Column) -> Column:
    """Street type and what follows it, by the first street word that opens the text; null when none does."""
    chosen: Column | None = None
    for word, street_type in fixed.STREET_WORDS:
        pattern = rf"^{word}\s+"
        hit = F.struct(F.lit(street_type).alias("kind"), F.regexp_replace(text, pattern, "").alias("rest"))
        chosen = F.when(text.rlike(pattern), hit) if chosen is None else chosen.when(text.rlike(pattern), hit)
    return chosen


def _split_street(opened: Column) -> Column:
    rest = opened["rest"]

    def read(g: Column) -> Column:
        return F.struct(
            opened["kind"].alias("kind"),
            lookup(opened["kind"], _CROSS_TYPE).alias("cross_kind"),
            _group(g, 0).isNotNull().alias("found"),
            _number_of(g).alias("number"),
            _group(g, 5).alias("suffix"),
            F.trim(F.substr(rest, F.length(F.get(g, F.lit(0))) + 1)).alias("after"),
        )

    return let(_groups(rest, _STREET_RE, 5), read)


def _read_cross(s: Column) -> Column:
    def read(g: Column) -> Column:
        return F.struct(
            s.alias("s"),
            (s["found"] & s["cross_kind"].isNotNull() & _group(g, 0).isNotNull()).alias("crossed"),
            _number_of(g).alias("number"),
            _group(g, 5).alias("suffix"),
            _group(g, 6).alias("plate"),
            _group(g, 7).alias("trailing"),
        )

    return let(_groups(s["after"], fixed.CROSS_STREET, 7), read)


def _assemble(c: Column) -> Column:
    s, trailing = c["s"], c["trailing"]
    # a quadrant after the plate belongs to whichever of the two streets can carry it
    floating = c["crossed"] & s["suffix"].isNull() & c["suffix"].isNull() & trailing.isNotNull()
    carries = lambda kind: F.when(trailing == "sur", kind.isin("calle", "diagonal")).otherwise(
        kind.isin("carrera", "transversal")
    )
    to_street, to_cross = floating & carries(s["kind"]), floating & ~carries(s["kind"]) & carries(s["cross_kind"])
    street = F.struct(
        s["kind"].alias("type"), s["number"].alias("number"), F.coalesce(s["suffix"], F.when(to_street, trailing)).alias("suffix")
    )
    cross = F.struct(
        s["cross_kind"].alias("type"), c["number"].alias("number"), F.coalesce(c["suffix"], F.when(to_cross, trailing)).alias("suffix")
    )
    return F.struct(
        F.when(F.coalesce(s["found"], F.lit(False)), street).alias("street"),
        F.when(c["crossed"], cross).alias("cross"),
        F.when(c["crossed"], c["plate"]).alias("plate"),
    )


def parse_address(address: Column) -> Column:
    """Struct (street, cross, plate) of an address text. Every step is named once, so the expression stays small."""
    return let(
        clean(address), lambda text: let(let(let(_opening(text), _split_street), _read_cross), _assemble)
    )


def parse_addresses(shops: DataFrame, address: str = "address") -> DataFrame:
    """Add ``street``, ``cross`` (structs type, number, suffix) and ``plate``; ``street`` is null when none is named."""
    parsed = shops.withColumn("_parsed", parse_address(F.col(address)))
    return parsed.withColumns({c: F.col(f"_parsed.{c}") for c in ("street", "cross", "plate")}).drop("_parsed")


def street_label(street: Column) -> Column:
    """``Carrera 6 Bis Sur`` from its parts."""

    def label(s: Column) -> Column:
        number = squeeze(F.replace(F.upper(s["number"]), F.lit("BIS"), F.lit(" Bis ")))
        suffix = F.when(s["suffix"] == "sur", " Sur").when(s["suffix"] == "este", " Este").otherwise("")
        return F.concat(F.initcap(s["type"]), F.lit(" "), number, suffix)

    return let(street, label)


def place_key(col: Column) -> Column:
    """A town without accents and filler words, so that its spellings are equal."""
    return squeeze(F.regexp_replace(clean(col), fixed.PLACE_NOISE, " "))


def is_department(col: Column) -> Column:
    return F.coalesce(place_key(col).isin(*fixed.DEPARTMENTS), F.lit(False))


def shop_targets(shops: DataFrame) -> DataFrame:
    """Parsed shops ready to ask for: shop_id, title, content (HTML), municipality, department.

    Town and department are swapped when they come reversed. ``target_problem`` says why a shop cannot be asked for.
    """

    def judge(t: Column) -> Column:
        swap = t["town"].isNotNull() & t["state"].isNotNull() & t["town_is"] & ~t["state_is"]
        town, town_is = F.when(swap, t["state"]).otherwise(t["town"]), F.when(swap, t["state_is"]).otherwise(t["town_is"])
        state, state_is = F.when(swap, t["town"]).otherwise(t["state"]), F.when(swap, t["town_is"]).otherwise(t["state_is"])
        problem = F.when(town.isNull() | town_is, "unknown municipality").when(
            t["parsed"]["street"].isNull(), "address without a street"
        )
        return F.struct(
            t["title"].alias("title_text"), t["text"].alias("address_text"), town.alias("municipality"),
            F.when(state_is, state).alias("department"), t["parsed"]["street"].alias("street"),
            t["parsed"]["cross"].alias("cross"), t["parsed"]["plate"].alias("plate"), problem.alias("target_problem"),
        )

    def read(text: Column) -> Column:
        return F.struct(
            text.alias("text"), html_to_text(F.col("title")).alias("title"), parse_address(text).alias("parsed"),
            F.col("municipality").alias("town"), F.col("department").alias("state"),
            is_department(F.col("municipality")).alias("town_is"), is_department(F.col("department")).alias("state_is"),
        )

    target = let(let(html_to_text(F.col("content")), read), judge)
    kept = [c for c in shops.columns if c not in ("municipality", "department")]
    return shops.withColumn("_target", target).select(*kept, "_target.*")


def _capital_words(col: Column) -> Column:
    marked = F.regexp_replace(fold(col), r"(?<![A-Za-z0-9_])([a-z])", "\u0001 $1")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def geocode_questions(targets: DataFrame) -> DataFrame:
    """Add ``address_query`` (``Carrera 80 50-87, Medellin, Antioquia``) and ``cross_query`` (null without a cross)."""

    def ask(t: Column) -> Column:
        place = F.concat(
            t["town"], F.when(t["state"].isNull(), "").otherwise(F.concat(F.lit(", "), t["state"]))
        )
        plate = F.when(F.col("plate").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("plate")))
        number = F.when(t["cross"].isNull(), "").otherwise(
            F.concat(F.lit(" "), F.regexp_replace(t["cross"], r"^\S+\s+", ""), plate)
        )
        return F.struct(
            F.concat(t["street"], number, F.lit(", "), place).alias("address_query"),
            F.when(t["cross"].isNotNull(), F.concat(t["cross"], F.lit(", "), place)).alias("cross_query"),
        )

    told = F.struct(
        street_label(F.col("street")).alias("street"), street_label(F.col("cross")).alias("cross"),
        _capital_words(F.col("municipality")).alias("town"), _capital_words(F.col("department")).alias("state"),
    )
    asked = targets.withColumn("_asked", F.when(F.col("target_problem").isNull(), let(told, ask)))
    return asked.select(*targets.columns, "_asked.address_query", "_asked.cross_query")


def _fresh(answers: DataFrame, now: Column) -> DataFrame:
    return answers.where(F.col("fetched_at") > now - F.expr(f"interval {fixed.HIT_MAX_AGE_DAYS} days"))


def geocode_requests(targets: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """The distinct questions still to ask: those without an answer landed in the last 180 days."""
    asked = targets.select(F.explode(F.array("address_query", "cross_query")).alias("query")).where("query is not null")
    return asked.distinct().join(_fresh(answers, now).select("query"), "query", "left_anti")


def combine_answers(answers: DataFrame, now: Column) -> DataFrame:
    """One row per question: ``hits`` and whether the source cut its list.

    ``answers``: query, shape (``every`` or ``folded``), fetched_at, raw_count, hits. A cut unfolded list is completed
    with the folded hits it does not have; the newest answer of each shape counts.
    """
    newest = (
        _fresh(answers, now)
        .groupBy("query")
        .agg(
            F.max_by(F.struct("hits", "raw_count"), F.when(F.col("shape") == "every", F.col("fetched_at"))).alias("every"),
            F.max_by("hits", F.when(F.col("shape") == "folded", F.col("fetched_at"))).alias("folded"),
        )
        .where("every is not null")
    )
    same = lambda a, b: (
        (a["lat"] == b["lat"]) & (a["lon"] == b["lon"]) & (a["category"] == b["category"])
        & (F.coalesce(a["name"], F.lit("")) == F.coalesce(b["name"], F.lit(""))) & (a["boundingbox"] == b["boundingbox"])
    )
    cut = F.col("every.raw_count") >= fixed.HIT_LIMIT
    more = F.filter("folded", lambda f: ~F.exists("every.hits", lambda e: same(e, f)))
    nothing = F.filter("every.hits", lambda e: F.lit(False))
    hits = F.concat("every.hits", F.when(cut, F.coalesce(more, nothing)).otherwise(nothing))
    return newest.select("query", hits.alias("hits"), cut.alias("truncated"))


# --- matching -----------------------------------------------------------------------------------------------------


def compact_road(col: Column) -> Column:
    road = F.regexp_replace(clean(col), r"([0-9])\s+([a-z])(?![a-z])", "$1$2")
    road = F.regexp_replace(road, rf"([0-9][a-z]?)\s*bis{fixed.WORD_END}", "$1bis")
    return F.regexp_replace(road, r"(bis)\s+([a-z])(?![a-z])", "$1$2")


def _has_word(text: Column, word: Column | str) -> Column:
    """A whole word or phrase of a squeezed text."""
    word = F.lit(word) if isinstance(word, str) else word
    return (word != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def _quadrants_equal(text: Column, suffix: Column) -> Column:
    here = lambda word: text.rlike(f"{fixed.WORD_START}{word}{fixed.WORD_END}")
    own = F.coalesce(suffix, F.lit(""))
    return (here("sur") == (own == "sur")) & (here("este") == (own == "este"))


def is_street(road: Column, street: Column) -> Column:
    """The compacted road is the street: same type or ``avenida``, same number, same quadrant."""
    named = _has_word(road, F.concat(street["type"], F.lit(" "), street["number"])) | _has_word(
        road, F.concat(F.lit("avenida "), street["number"])
    )
    return F.coalesce(named & _quadrants_equal(road, street["suffix"]), F.lit(False))


def match_house_number(house_number: Column, cross: Column, plate: Column) -> Column:
    """``exact``, ``cross`` (same cross street, other plate) or null; a lone number says nothing."""

    def judge(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:bis)?[a-z]?(?![a-z]))"), F.lit(1))
        first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
        same = (F.size(tokens) >= 2) & (first == cross["number"]) & _quadrants_equal(text, cross["suffix"])
        exact = second.try_cast("bigint") == plate.try_cast("bigint")
        return F.when(same & F.coalesce(exact, F.lit(False)), "exact").when(same, "cross")

    return F.when(house_number.isNotNull() & cross.isNotNull(), let(compact_road(house_number), judge))


def _department_key(col: Column) -> Column:
    key = place_key(col)
    return F.when(key.rlike(f"^archipielago de san andres{fixed.WORD_END}"), "san andres").otherwise(key)


def _words(col: Column) -> Column:
    return squeeze(F.regexp_replace(clean(col), "[^a-z0-9 ]+", " "))


def _field(hit: Column, name: str) -> Column:
    return F.try_element_at(hit["address"], F.lit(name))


def _read_hit(hit: Column) -> Column:
    """What the rules need of a hit, worked out once: place, box, road, house, town fit, settlements."""
    town = F.col("town_key")
    fits_town = F.lit(False)
    for name in fixed.PLACE_FIELDS:
        fits_town = fits_town | F.coalesce(place_key(_field(hit, name)) == town, F.lit(False))
    fits_department = F.col("department_key").isNull() | (
        _department_key(F.coalesce(_field(hit, "state"), F.lit(""))) == F.col("department_key")
    )
    outline = F.coalesce(clean(_field(hit, "city")).rlike(f"^(?:perimetro|casco) urbano{fixed.WORD_END}"), F.lit(False))

    def settlement(name: str) -> Column:
        key = place_key(_field(hit, name))
        return F.when(~outline & (key != "") & (key != town), _words(_field(hit, name)))

    highway = F.coalesce(hit["category"] == "highway", F.lit(False))
    road = compact_road(_field(hit, "road"))
    box = hit["boundingbox"]
    return F.struct(
        hit["lat"].alias("lat"),
        hit["lon"].alias("lon"),
        hit["place_rank"].alias("rank"),
        highway.alias("highway"),
        road.alias("road"),
        F.when(highway, F.coalesce(compact_road(hit["name"]), road)).alias("piece_road"),
        _field(hit, "house_number").alias("house"),
        (in_country(hit["lat"], hit["lon"]) & (town != "") & fits_town & fits_department).alias("local"),
        F.coalesce(place_key(_field(hit, "city")) == town, F.lit(False)).alias("in_city"),
        F.filter(F.array(*[settlement(n) for n in fixed.SETTLEMENT_FIELDS]), lambda s: s.isNotNull()).alias("settlements"),
        F.struct(
            F.get(box, F.lit(0)).alias("south"), F.get(box, F.lit(1)).alias("north"),
            F.get(box, F.lit(2)).alias("west"), F.get(box, F.lit(3)).alias("east"),
        ).alias("box"),
    )


def _union_box(boxes: Column) -> Column:
    pick = lambda name: F.transform(boxes, lambda b: b[name])
    return F.struct(
        F.array_min(pick("south")).alias("south"), F.array_max(pick("north")).alias("north"),
        F.array_min(pick("west")).alias("west"), F.array_max(pick("east")).alias("east"),
    )


def _diagonal(box: Column) -> Column:
    return box_diagonal_m(box["south"], box["north"], box["west"], box["east"])


def _meeting(a: Column, b: Column) -> Column:
    """Where two boxes touch, widened a little, or null."""
    box = F.struct(
        (F.greatest(a["south"], b["south"]) - fixed.TOUCH_DEGREES).alias("south"),
        (F.least(a["north"], b["north"]) + fixed.TOUCH_DEGREES).alias("north"),
        (F.greatest(a["west"], b["west"]) - fixed.TOUCH_DEGREES).alias("west"),
        (F.least(a["east"], b["east"]) + fixed.TOUCH_DEGREES).alias("east"),
    )
    return let(
        box,
        lambda m: F.when(
            (m["south"] <= m["north"]) & (m["west"] <= m["east"]) & (_diagonal(m) <= fixed.MAX_CORNER_M), m
        ),
    )


def _near_any(box: Column, boxes: Column) -> Column:
    return F.exists(boxes, lambda o: box_gap_m(o, box) <= fixed.MAX_STREET_GAP_M)


def _one_street(seeds: Column, boxes: Column) -> Column:
    """All pieces can be reached from the corner ones in steps of at most a kilometre."""

    def grow(reached: Column, _: Column) -> Column:
        return F.filter(boxes, lambda b: F.array_contains(reached, b) | _near_any(b, reached))

    # each round reaches one step further, so as many rounds as pieces reach everything that can be
    reached = F.aggregate(boxes, seeds, grow)
    return F.forall(boxes, lambda b: F.array_contains(reached, b))


def resolve_locations(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Place every shop: ``precision`` (address, intersection or street), latitude and longitude, or ``geocode_problem``.

    ``targets`` come from ``geocode_questions`` (column ``title_text`` and ``address_text`` are the hints), ``answers``
    from ``combine_answers``.
    """
    told = answers.select("query", "hits", "truncated")
    by_address = told.withColumnsRenamed({"query": "address_query", "hits": "_hits", "truncated": "_cut"})
    by_cross = told.select(F.col("query").alias("cross_query"), F.col("hits").alias("_cross_hits"))
    rows = (
        targets.join(by_address, "address_query", "left")
        .join(by_cross, "cross_query", "left")
        .withColumns({"town_key": place_key(F.col("municipality")), "department_key": _department_key(F.col("department"))})
    )
    empty = F.from_json(F.lit("[]"), f"array<{OSM_HIT}>")
    rows = rows.withColumns(
        {
            "a": F.transform(F.coalesce("_hits", empty), _read_hit),
            "c": F.transform(F.coalesce("_cross_hits", empty), _read_hit),
        }
    )
    none = F.lit(False)
    street, cross = F.col("street"), F.col("cross")
    piece = lambda of: lambda h: h["highway"] & h["local"] & F.coalesce(is_street(h["piece_road"], of), none)
    rows = rows.withColumns(
        {
            "numbered": F.filter(
                F.transform(
                    F.filter("a", lambda h: (h["rank"] >= 30) & h["local"] & F.coalesce(is_street(h["road"], street), none)),
                    lambda h: F.struct(
                        match_house_number(h["house"], cross, F.col("plate")).alias("match"), h["lat"].alias("lat"), h["lon"].alias("lon")
                    ),
                ),
                lambda n: n["match"].isNotNull(),
            ),
            "every_piece": F.filter("a", piece(street)),
            "cross_pieces": F.filter("c", piece(cross)),
        }
    )
    exact = F.get(F.filter("numbered", lambda n: n["match"] == "exact"), F.lit(0))
    settlements = lambda arr: F.flatten(F.transform(arr, lambda h: h["settlements"]))
    known = F.filter(F.concat("a", "c"), lambda h: h["local"])
    rows = rows.withColumns(
        {
            "building": F.coalesce(exact, F.get("numbered", F.lit(0))),
            "both": F.concat("every_piece", "cross_pieces"),
            "hints": F.array(_words(F.coalesce("title_text", F.lit(""))), _words(F.coalesce("address_text", F.lit("")))),
        }
    ).withColumn(
        "named", F.filter(F.array_distinct(settlements(known)), lambda s: F.exists("hints", lambda hint: _has_word(hint, s)))
    )
    untagged = F.transform(F.filter("both", lambda h: F.size(h["settlements"]) == 0), lambda h: h["box"])
    kinds = F.size(F.array_distinct(F.transform("both", lambda h: F.array_join(h["settlements"], "|"))))
    rows = rows.withColumns({"untagged": untagged, "is_named": F.size("named") > 0, "uniform": kinds <= 1}).withColumn(
        "pieces",
        F.when(F.col("is_named"), F.filter("every_piece", lambda h: F.arrays_overlap(h["settlements"], F.col("named"))))
        .when(F.col("uniform"), F.col("every_piece"))
        .otherwise(F.filter("every_piece", lambda h: _near_any(h["box"], F.col("untagged")))),
    )
    boxes = F.transform("pieces", lambda h: h["box"])
    rows = rows.withColumns({"boxes": boxes, "cross_boxes": F.transform("cross_pieces", lambda h: h["box"])}).withColumn(
        "meetings",
        F.transform(
            "boxes",
            lambda a: F.struct(
                a.alias("piece"),
                F.filter(F.transform("cross_boxes", lambda b: _meeting(a, b)), lambda m: m.isNotNull()).alias("at"),
            ),
        ),
    )
    corners = F.flatten(F.transform("meetings", lambda m: m["at"]))
    seeds = F.transform(F.filter("meetings", lambda m: F.size(m["at"]) > 0), lambda m: m["piece"])
    lone = F.when(F.col("is_named"), F.col("boxes")).otherwise(F.transform("every_piece", lambda h: h["box"]))
    rows = rows.withColumns({"corners": corners, "seeds": seeds, "span": _union_box(lone)}).withColumn(
        "corner", _union_box(F.col("corners"))
    )
    has_corner = F.size("corners") > 0
    is_city = F.exists("every_piece", lambda h: h["in_city"])
    repeated = (F.col("is_named") | ~is_city) & ~_one_street(F.col("seeds"), F.col("boxes"))
    too_long = "only the street, too long to place"
    far_cross = (F.size("cross_boxes") > 0) & F.forall(
        "cross_boxes", lambda b: box_gap_m(F.col("span"), b) > fixed.MAX_CROSS_AWAY_M
    )
    no_piece = F.size("every_piece") == 0
    problem = (
        F.when(F.col("building").isNotNull(), None)
        .when(F.size("a") == 0, "no result")
        .when(no_piece & F.exists("a", lambda h: h["local"]), "street not found")
        .when(no_piece, "another municipality")
        .when(F.col("is_named") & (F.size("pieces") == 0), "street not found in the named settlement")
        .when(F.size("pieces") == 0, "street only in a settlement the shop does not name")
        .when(has_corner & (_diagonal(F.col("corner")) > fixed.MAX_CORNER_SPREAD_M), "ambiguous corner")
        .when(has_corner, F.when(repeated, "the street repeats elsewhere in the town"))
        .when(F.coalesce("_cut", none), too_long)
        .when(_diagonal(F.col("span")) > fixed.MAX_STREET_SPAN_M, too_long)
        .when(~F.col("is_named") & F.col("uniform") & (F.size("untagged") == 0), "short street in a settlement the shop does not name")
        .when(far_cross, "the cross street exists, but far from the street")
    )
    asked = F.col("target_problem").isNull()
    decided = rows.withColumn("geocode_problem", F.when(asked, problem))
    ok = asked & F.col("geocode_problem").isNull()
    precision = F.when(F.col("building").isNotNull(), "address").when(has_corner, "intersection").otherwise("street")
    place = F.when(has_corner, F.col("corner")).otherwise(F.col("span"))
    latitude = F.coalesce("building.lat", (place["south"] + place["north"]) / 2)
    longitude = F.coalesce("building.lon", (place["west"] + place["east"]) / 2)
    return decided.select(
        *targets.columns,
        F.when(ok, precision).alias("precision"),
        "geocode_problem",
        F.when(ok, latitude).alias("latitude"),
        F.when(ok, longitude).alias("longitude"),
    )


def outcome_tally(resolved: DataFrame) -> DataFrame:
    """Shops per outcome: how they were placed or why not."""
    return resolved.groupBy(F.coalesce("target_problem", "geocode_problem", "precision").alias("outcome")).agg(
        F.count(F.lit(1)).alias("shops")
    )
