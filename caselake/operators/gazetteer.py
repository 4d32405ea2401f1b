"""Places named in text: lookups of one place or all, what is no place, and the place of a case.

The gazetteer is a stated vocabulary of bounded size; a text is read once for all of its names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .wordings import NAME_PARTICLES, Finder, Form, as_name, bounded, cached, exact, folded, next_word, words_before

# Words before a name that make it a road or a person, and words that make it the region or its emirate.
NAME_BEFORE = ("طريق", "شارع", "الامير", "الملك", "الشيخ", "بن", "ابن", "بنت", "ابو")
REGION_BEFORE = ("منطقه", "اماره", "امير")
# The same for names in Latin script, persons before a name and roads after it, regions and their rulers.
PERSONS_EN = ("king", "prince", "princess", "sheikh", "shaikh", "bin", "ibn", "bint", "abu")
ROADS_EN = ("road", "rd", "street", "st", "highway", "hwy", "expressway", "avenue", "ave")
REGIONS_EN = ("region", "province", "emirate", "principality")
RULERS_EN = ("prince", "emir", "amir")
# Articles of Latin names; the joined ones may be written together with the name.
ARTICLES_EN, JOINED_EN = ("al", "el", "ar", "as", "az", "ad", "adh", "ash", "at", "ath", "an"), ("al", "el")
# What follows an ambiguous name that opens an address.
ADDRESS_WORDS = ("حي", "شارع")
_LATIN_WORD, _LATIN_GAP = re.compile("[a-zà-ɏ]+"), re.compile(r"[\s'’‘`\-]+")
FOUND = "array<struct<clear:boolean,city:boolean,size:int,early:int,area:string,name:string>>"
#: Where segments of an address end.
SEGMENTS = r"[\n\r,،;؛/|()\[\]\-–—]+"


@dataclass(frozen=True)
class Place:
    """A name of an area. ``city`` names outrank others; an ambiguous name counts only as a whole segment of a text."""

    name: str
    area: str
    city: bool = True
    ambiguous: bool = False

    @property
    def latin(self) -> bool:
        return self.name.isascii()

    @property
    def words(self) -> list[str]:
        """The words of a Latin name without articles."""
        return [w for w in _LATIN_WORD.findall(self.name.lower()) if w not in ARTICLES_EN]

    @property
    def size(self) -> int:
        return len(" ".join(self.words)) if self.latin else len(folded(self.name))


class _Latin:
    """Latin names in a text: words one after the other, an article before each or not, outside addresses and domains."""

    def __init__(self, places: list[tuple[int, Place]]):
        self.by_first: dict[str, list[tuple[int, list[str]]]] = {}
        for i, p in places:
            if p.words:
                self.by_first.setdefault(p.words[0], []).append((i, p.words))

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        if not self.by_first:
            return
        text = text.lower()
        words = [(m[0], m.start(), m.end()) for m in _LATIN_WORD.finditer(text)]
        near = [k == 0 or bool(_LATIN_GAP.fullmatch(text, words[k - 1][2], words[k][1])) for k in range(len(words))]

        def core(k: int) -> list[str]:
            word = words[k][0]
            return [word, *(word[len(a) :] for a in JOINED_EN if word.startswith(a) and len(word) > len(a))]

        for k in range(len(words)):
            for first in core(k):
                for i, names in self.by_first.get(first, ()):
                    last = k
                    for name in names[1:]:
                        last += 1
                        if last < len(words) and near[last] and words[last][0] in ARTICLES_EN and name not in core(last):
                            last += 1
                        if last >= len(words) or not near[last] or name not in core(last):
                            break
                    else:
                        start = words[k - 1][1] if k and near[k] and words[k - 1][0] in ARTICLES_EN else words[k][1]
                        end = words[last][2]
                        whole = not re.match(r"[\w@.]", text[start - 1 : start]) and not re.match(r"\w|@|\.\w", text[end : end + 2])
                        if whole:
                            yield i, start, end


class _Gazetteer:
    """The places that a text in search form names, each at its first counting occurrence."""

    def __init__(self, places: list[Place], towns: bool):
        self.places, self.towns = places, towns
        clear = [(i, p) for i, p in enumerate(places) if not p.ambiguous and not p.latin]
        self.number = [i for i, _ in clear]
        self.finder = Finder([self._forms(p.name) for _, p in clear])
        self.latin = _Latin([(i, p) for i, p in enumerate(places) if p.latin and not p.ambiguous])
        self.vague = [(i, self._forms(p.name)) for i, p in enumerate(places) if p.ambiguous]
        self.vague_finder = Finder([forms for _, forms in self.vague])
        self.region = [Form(w, NAME_PARTICLES, frozenset({""})) for w in REGION_BEFORE]

    @staticmethod
    def _forms(name: str) -> list[list[Form]]:
        first, *rest = name.split()
        return [as_name(first), *([exact(w) for w in rest])]

    def _arabic_counts(self, text: str, start: int) -> bool:
        before = words_before(text, start, 1)
        return not before or not (before[0] in NAME_BEFORE or (self.towns and any(f.fits(before[0]) for f in self.region)))

    def _latin_counts(self, text: str, start: int, end: int) -> bool:
        before, after = words_before(text, start), next_word(text, end, adjacent=True)
        if before[:1] and before[0] in PERSONS_EN or after in ROADS_EN:
            return False
        owner = [w for w in before if w != "the"] if before[:1] == ["the"] else before
        ruled = len(owner) > 1 and owner[0] == "of" and owner[1] in (*REGIONS_EN, *RULERS_EN)
        return not self.towns or not (ruled or after in REGIONS_EN)

    def _whole_segments(self, text: str, segments: list[str]) -> Iterator[int]:
        """Ambiguous names that are a whole segment, or that open the text before a word of addresses."""
        if self.vague:
            for part in segments:
                part = part.strip()
                bare = re.sub(r"^\W+|\W+$", "", part)
                yield from (self.vague[k][0] for k, a, b in self.vague_finder.hits(bare) if a == 0 and b == len(bare))
            yield from (self.vague[k][0] for k, a, b in self.vague_finder.hits(text[:200]) if a == 0 and text[b : b + 1] == " " and next_word(text, b) in ADDRESS_WORDS)

    def of(self, text: str, segments: list[str]) -> list[dict]:
        first: dict[int, int] = {}
        for k, a, _ in self.finder.hits(text):
            if self.number[k] not in first and self._arabic_counts(text, a):
                first[self.number[k]] = a
        lower = text.lower()
        for i, a, b in self.latin.hits(text):
            if i not in first and self._latin_counts(lower, a, b):
                first[i] = a
        for i in self._whole_segments(text, segments):
            first[i] = 0
        return [{"clear": not p.ambiguous, "city": p.city, "size": p.size, "early": -at, "area": p.area, "name": p.name} for i, at in sorted(first.items()) for p in (self.places[i],)]


def _candidates(text: Column, places: list[Place], towns: bool) -> Column:
    """array<struct<clear, city, size, early, area, name>> of the names that count, each at its first place; the greatest wins."""
    bounded(places)
    model = cached(lambda: _Gazetteer(list(places), towns))

    def run(norms: pd.Series, segments: pd.Series) -> pd.Series:
        gazetteer = model()
        return pd.Series([gazetteer.of(t or "", list(x) if x is not None else []) for t, x in zip(norms, segments, strict=True)])

    vague = any(p.ambiguous for p in places)
    segments = F.transform(F.split(text, SEGMENTS), lambda p: X.normalize(p)) if vague else F.array().cast("array<string>")
    return F.pandas_udf(run, FOUND)(X.normalize(text), segments)


def area_of(text: Column, places: list[Place], towns: bool = False) -> Column:
    """The area of the winning name: unambiguous, city, longest, earliest; null without one. ``towns``: names of the region are no towns."""
    return F.array_max(_candidates(text, places, towns))["area"]


def place_of(text: Column, places: list[Place], towns: bool = False) -> Column:
    """struct(clear, city, size, early, area, name) of the winning name, as ``area_of`` chooses it; null without one."""
    return F.array_max(_candidates(text, places, towns))


def areas_in(text: Column, places: list[Place], towns: bool = False) -> Column:
    """Every area named, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_candidates(text, places, towns), lambda k: k["area"])))


def resolve(
    df: DataFrame, incident: Column, city: Column, district: Column, model_region: Column, model_town: Column, support: Column, home: str, towns: list[Place], regions: list[Place], into: str = "place"
) -> DataFrame:
    """``df`` with struct(region, region_source, town, town_source) of a case from its verified place values, then the model.

    Tried in turn: where it happened, the city, city with district. A town sets both; another region's city stops the search
    unless the home region was named before. The model's word counts only if ``support`` names the same place.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    both = F.when(~blank(city) & ~blank(district), F.concat_ws("، ", city, district)).otherwise(F.coalesce(city, district))
    looked = {}
    for k, text in enumerate((incident, city, both)):
        looked |= {f"__town{k}": area_of(text, towns, towns=True), f"__region{k}": area_of(text, regions), f"__text{k}": ~blank(text)}
    looked |= {"__regions": areas_in(support, regions), "__towns": areas_in(support, towns, towns=True)}
    found = df.withColumns(looked)
    tries = []
    for k in range(3):
        town = F.col(f"__town{k}")
        region = F.when(town.isNotNull(), F.lit(home)).otherwise(F.col(f"__region{k}"))
        tries.append(F.when(F.col(f"__text{k}"), F.struct(town.alias("town"), region.alias("region"))))

    def step(acc: Column, t: Column) -> Column:
        stop = acc["done"] | t.isNull()
        foreign = t["region"].isNotNull() & (t["region"] != home) & ~acc["home"]
        fresh = F.struct(
            (t["town"].isNotNull() | foreign).alias("done"), (acc["home"] | F.coalesce(t["region"] == home, F.lit(False))).alias("home"),
            t["town"].alias("town"), F.when(foreign, t["region"]).alias("foreign"),
        )
        return F.when(stop, acc).otherwise(fresh)

    nothing = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("home"), nothing.alias("town"), nothing.alias("foreign"))
    g = F.col("__got")
    known = lambda c: ~blank(c) & (c != "unknown")
    said_region = known(model_region) & F.array_contains("__regions", model_region)
    said_town = known(model_town) & F.array_contains("__towns", model_town)
    region = F.when(g["town"].isNotNull() | g["home"], F.lit(home)).when(g["foreign"].isNotNull(), g["foreign"]).when(said_region, model_region).when(said_town, F.lit(home))
    source = F.when(g["town"].isNotNull(), "place_map").when(g["home"] | g["foreign"].isNotNull(), "city_map").when(said_region | said_town, "llm")
    town = F.when(g["town"].isNotNull(), g["town"]).when(said_town & g["foreign"].isNull() & (region == home), model_town)
    place = F.struct(
        F.coalesce(region, F.lit("unknown")).alias("region"), F.coalesce(source, F.lit("none")).alias("region_source"), F.coalesce(town, F.lit("unknown")).alias("town"),
        F.when(g["town"].isNotNull(), "place_map").when(town.isNotNull(), "llm").otherwise("none").alias("town_source"),
    )
    return found.withColumn("__got", F.aggregate(F.array(*tries), start, step)).withColumn(into, place).drop(*looked, "__got")


def support_text(text: Column, addressee: Column, entity_names: list[str]) -> Column:
    """The folded text without its addressee line and the entity's own names: what may back a place."""
    to = X.fold(F.coalesce(addressee, F.lit("")))
    out = F.when(F.length(to) >= 3, F.replace(X.fold(text), to, F.lit(" "))).otherwise(X.fold(text))
    for name in sorted(entity_names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, r"(?U)(?<!\w)[وف]?[بلك]?" + re.escape(folded(name).lower()) + r"(?!\w)", " ")
    return out


def addressed_to(addressee: Column, entity_names: list[str]) -> Column:
    """An addressee that names the entity, or none at all."""
    to = X.fold(F.coalesce(addressee, F.lit("")))
    return (to == "") | to.rlike(r"(?U)(?<!\w)[وف]?[بلك]?(?:" + "|".join(re.escape(folded(n).lower()) for n in entity_names) + r")(?!\w)")


def couple(region: Column, town: Column, old_region: Column, old_town: Column, home: str) -> Column:
    """A correction's (region, town) kept consistent; null inputs are not part of the correction.

    A town implies the home region; any other region has no town of ours: the town becomes unknown, and naming one is refused.
    """
    known = lambda c: F.coalesce((c != "") & (c != "unknown"), F.lit(False))
    named = known(town)
    new = F.when(named & region.isNull(), F.lit(home)).otherwise(region)
    effective = F.coalesce(new, old_region)
    fine = F.coalesce(effective == home, F.lit(False)) | (~known(effective) & new.isNull())
    cleared = ~fine & (town.isNotNull() | known(old_town))
    return F.struct((named & ~fine).alias("refused"), new.alias("region"), F.when(named & ~fine, F.lit(None)).when(cleared, "unknown").otherwise(town).alias("town"))
