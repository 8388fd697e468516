"""Rule-based classification: document types, extraction routes, answer councils, question ranking, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.dims import DIMENSIONS, dimension_value
from lumenarc.functions.text import col, score_quality

#: Item types of the library and the document types they mean.
ITEM_TYPES = {
    "journalArticle": "research_paper", "conferencePaper": "research_paper", "preprint": "research_paper", "book": "book_monograph",
    "bookSection": "book_monograph", "thesis": "thesis", "report": "report", "magazineArticle": "non_academic", "newspaperArticle": "non_academic",
    "blogPost": "non_academic", "presentation": "non_academic",
}
#: Phrases and thresholds of the rules below.
REVIEW = r"(?i)\b(systematic\s+review|meta[-\s]?analysis|literature\s+review|scoping\s+review|narrative\s+review|integrative\s+review|rapid\s+review|umbrella\s+review)\b"
ACADEMIC = r"(?i)\b(we\s+hypothesiz|this\s+study|our\s+findings|this\s+paper\s+(?:presents|examines|investigates)|the\s+results\s+(?:show|indicate|suggest|demonstrate)|we\s+(?:propose|argue|demonstrate|analyze|examine|investigate)|our\s+(?:analysis|results|approach|method|contribution))\b"
BRACKET_CITE, NAME_CITE = r"\[\d+\]", r"\([A-Z][a-z]+(?:\s+(?:et\s+al\.?|&\s+[A-Z]))?,?\s*\d{4}\)"
WEB_TITLES = r"(?i)\b(guideline|guidance|position statement|framework|report|white paper|policy|technology transfer|regulatory science|standard|reference|adaptive cycle)\b"
WEB_DOMAINS = r"(?i)(?:who\.int|ema\.europa\.eu|fda\.gov|tga\.gov\.au|resalliance\.org)"
FORMULA = r"\b(equation|formula|theorem|lemma|proof|corollary|optimization|objective|lagrangian|gradient|derivative|integral|tensor|matrix|eigenvalue|bayesian|quantum|topology|algebra)\b"
PICTURE = r"\b(fig(?:ure)?\.?|chart|plot|diagram|image|visualization|heatmap|scatterplot|bar chart|flowchart|schematic)\b"
OCR = r"\b(scanned|ocr|facsimile|handwritten|archival|typewritten)\b"
MATH_HEAVY = "mathematics|mathematical|algebra|geometry|topology|optimization|theorem|proof|quantum|physics|statistics"
FIGURE_HEAVY = "visualization|imaging|chart|diagram|plot|remote sensing|microscopy|radiology|vision"


def verdict(kind: Column | str | None, confidence) -> Column:
    kind = F.lit(kind) if not isinstance(kind, Column) else kind
    return F.struct(kind.cast("string").alias("type"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"))


def has(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")) != ""


def classify_metadata(item_type="item_type", title="title", url="url", doi="doi", isbn="isbn", journal="journal") -> Column:
    """Type and confidence from metadata alone; type is null where they say too little."""
    kinds = F.create_map(*[F.lit(x) for p in ITEM_TYPES.items() for x in p])
    mapped = F.try_element_at(kinds, col(item_type))
    low = F.lower(F.coalesce(col(title), F.lit("")))
    web = F.when(has(doi), verdict("research_paper", 0.7)).when(F.lower(F.coalesce(col(url), F.lit(""))).rlike(WEB_DOMAINS) | low.rlike(WEB_TITLES), verdict("report", 0.65)).otherwise(verdict("reference_material", 0.55))
    bonus = lambda c: F.when(has(c), 0.05).otherwise(0.0)
    paper = F.when(low.rlike(REVIEW), verdict("review_paper", 0.9)).otherwise(verdict("research_paper", F.round(0.85 + bonus(doi) + bonus(journal), 2)))
    known = F.when(mapped == "research_paper", paper).when(mapped == "book_monograph", verdict("book_monograph", F.when(has(isbn), 0.95).otherwise(0.85))).otherwise(verdict(mapped, 0.85))
    vague = F.when(has(doi), verdict("research_paper", 0.6)).when(has(isbn), verdict("book_monograph", 0.6)).otherwise(verdict(None, 0.3))
    rest = F.when(has(doi) & has(journal), verdict("research_paper", 0.7)).when(has(isbn), verdict("book_monograph", 0.6)).otherwise(verdict(None, 0.2))
    return F.when(col(item_type) == "webpage", web).when(mapped.isNotNull(), known).when(col(item_type) == "document", vague).otherwise(rest)


def classify_text(text: Column | str, meta_type: Column | str, words: Column, pages: Column, markers: Column) -> Column:
    """Type and confidence from the text's size, sections, citations and phrases; the metadata's type is confirmed or replaced."""
    t, meta = col(text), col(meta_type)
    sample, longer = F.substring(t, 1, 5000), F.substring(t, 1, 20000)
    pages = F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1))
    cites = F.regexp_count(longer, F.lit(BRACKET_CITE)) + F.regexp_count(longer, F.lit(NAME_CITE))
    seen = F.greatest(F.size(F.filter(F.split(longer, r"\s+"), lambda w: w != "")), F.lit(1))
    density = cites / seen * 1000
    phrases = F.regexp_count(sample, F.lit(ACADEMIC))
    bonus = F.when(meta == "research_paper", F.when(markers >= 3, 0.1).otherwise(0.0) + F.when(phrases >= 2, 0.05).otherwise(0.0) + F.when(density > 5, 0.05).otherwise(0.0)).otherwise(0.0)
    return (
        F.when(words < 200, verdict("non_academic", 0.85))
        .when((words / pages < 50) & (pages > 3), verdict("non_academic", 0.8))
        .when((words > 40000) & (meta == "thesis"), verdict("thesis", 0.95))
        .when((words > 40000) & (meta == "book_monograph"), verdict("book_monograph", 0.95))
        .when(words > 40000, verdict("book_monograph", 0.7))
        .when(sample.rlike(REVIEW) & (meta.isNull() | meta.isin("research_paper", "review_paper")), verdict("review_paper", 0.85))
        .when(meta.isNotNull(), verdict(meta, F.round(0.8 + bonus, 2)))
        .when((markers >= 4) & (density > 5) & (phrases >= 2), verdict("research_paper", 0.75))
        .when(markers >= 4, verdict("research_paper", 0.65))
        .when(density > 10, verdict("research_paper", 0.6))
        .when((density < 2) & (phrases < 2) & (words > 5000), verdict("report", 0.5))
        .when((density < 2) & (phrases < 2), verdict("non_academic", 0.6))
        .otherwise(verdict("research_paper", 0.5))
    )


def classify(meta: Column, by_text: Column, has_text: Column, sure: float = 0.8) -> Column:
    """The metadata's verdict if it is sure, else the text's; without a text the metadata's or a weak guess."""
    return F.when(meta["type"].isNotNull() & (meta["confidence"] >= sure), meta).when(has_text, by_text).when(meta["type"].isNotNull(), meta).otherwise(verdict("research_paper", 0.3))


def extraction_intent(text: Column, title: Column, words: Column, pages: Column, tier: str = "cheap_text_pass", pictures: bool = False) -> Column:
    """Route for reading a document: intent, confidence and hit counts."""
    both = F.lower(F.concat_ws(" ", title, text))
    hits = lambda p: F.regexp_count(both, F.lit(p))
    per_page = F.coalesce(words / F.greatest(pages, F.lit(1)), F.lit(0.0))
    scanned = F.coalesce((pages >= 4) & ((words < 500) | (per_page < 80)), F.lit(False)) | F.coalesce((F.length(F.trim(text)) < 600) & (pages >= 6), F.lit(False)) | (hits(OCR) > 0)
    formula = (hits(FORMULA) >= 2) | F.lower(title).rlike(MATH_HEAVY)
    picture = ((hits(PICTURE) >= 2) | F.lower(title).rlike(FIGURE_HEAVY)) & F.lit(pictures)
    flags = scanned.cast("int") + formula.cast("int") + picture.cast("int")
    low, high = {"metadata_only": (0.3, 0.45), "cheap_text_pass": (0.55, 0.68), "stored_snapshot": (0.7, 0.82)}[tier]
    confidence = F.when(flags >= 2, F.least(F.lit(high + 0.12), F.lit(0.95))).when(flags == 1, F.least(F.lit(high + 0.08), F.lit(0.9))).otherwise(low)
    name = F.when(flags == 0, "fast").otherwise(F.concat_ws("_", F.lit("hybrid"), F.when(scanned, "ocr"), F.when(formula, "formula"), F.when(picture, "picture")))
    return F.struct(name.alias("intent"), F.round(confidence, 3).alias("confidence"), hits(FORMULA).alias("formula_hits"), hits(PICTURE).alias("picture_hits"), hits(OCR).alias("ocr_hits"))


def hybrid_profile(intent: Column | str, backend: str = "docling", client: str = "auto", pictures: bool = False) -> Column:
    """The backend profile's key for an intent."""
    i = F.coalesce(col(intent), F.lit("fast"))
    flag = lambda n: F.contains(i, F.lit(n))
    ocr, formula, picture = flag("ocr"), flag("formula"), flag("picture") & F.lit(pictures)
    mode = F.when(formula | picture, "full").otherwise(client)
    key = F.format_string(f"hybrid:backend={backend}:client=%s:ocr=%d:formula=%d:picture=%d", mode, ocr.cast("int"), formula.cast("int"), picture.cast("int"))
    return F.when(ocr | formula | picture, key).otherwise("fast")


def council_longest(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The longest answer of each group; among equals the first (pos)."""
    return answers.where("value is not null and value <> ''").groupBy(*keys).agg(F.max_by("value", F.struct(F.length("value"), -F.col("pos"))).alias("value"))


def council_weighted(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The answer of the highest quality times weight, then the longest, then the first."""
    score = score_quality("value") * F.col("weight")
    return answers.where("value is not null and value <> ''").groupBy(*keys).agg(F.max_by("value", F.struct(score, F.length("value"), -F.col("pos"))).alias("value"))


def council_union(answers: DataFrame, keys: list[str], overlap: float = 0.6) -> DataFrame:
    """Sentences of all answers in order of weight, less those that share `overlap` of their words (of the smaller set) with a kept one."""
    given = answers.where("value is not null and value <> ''")
    ordered = given.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "pos", "value"))).alias("all"))
    parts = F.flatten(F.transform("all", lambda a: F.filter(F.transform(F.split(a["value"], r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")))
    words = lambda s: F.array_distinct(F.split(F.lower(s), r"\s+"))
    near = lambda s, k: F.size(F.array_intersect(words(s), words(k))) >= overlap * F.least(F.size(words(s)), F.size(words(k)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda k: near(s, k)), acc).otherwise(F.concat(acc, F.array(s))))
    return ordered.select(*keys, F.array_join(kept, " ").alias("value"))


STRATEGIES = {"longest": council_longest, "quality_weighted": council_weighted, "union": council_union}


def consensus(answers: DataFrame, core: list[str], total: int, providers: int) -> DataFrame:
    """answers (paper_id, provider, dimension, value): 0.6 response rate + 0.4 agreement (word overlap on core dimensions, spread of filled counts)."""
    given = answers.where("value is not null and value <> ''")
    tokens = given.where(F.col("dimension").isin(core)).select("paper_id", "dimension", "provider", F.array_distinct(F.split(F.lower("value"), r"\s+")).alias("t"))
    a, b = tokens.alias("a"), tokens.alias("b")
    pairs = a.join(b, (F.col("a.paper_id") == F.col("b.paper_id")) & (F.col("a.dimension") == F.col("b.dimension")) & (F.col("a.provider") < F.col("b.provider")))
    both = F.size(F.array_intersect("a.t", "b.t")) / F.size(F.array_union("a.t", "b.t"))
    agree = pairs.groupBy(F.col("a.paper_id").alias("paper_id"), F.col("a.dimension").alias("dimension")).agg(F.avg(both).alias("s"))
    fill = answers.groupBy("paper_id", "provider").agg(F.count_if(F.col("value").isNotNull() & (F.col("value") != "")).alias("n"))
    spread = fill.groupBy("paper_id").agg(F.count("*").alias("responses"), F.when(F.max("n") > 0, 1 - (F.max("n") - F.min("n")) / total).otherwise(0.5).alias("spread"))
    scores = agree.select("paper_id", "s").unionByName(spread.where("responses >= 2").select("paper_id", F.col("spread").alias("s")))
    mean = scores.groupBy("paper_id").agg(F.avg("s").alias("agreement"))
    out = spread.join(mean, "paper_id", "left")
    return out.select("paper_id", "responses", F.least(0.6 * F.col("responses") / providers + 0.4 * F.coalesce("agreement", F.lit(0.5)), F.lit(1.0)).alias("confidence"))


#: What a question's style adds to its relevance.
STYLES = {"causal": 0.15, "comparative": 0.12, "evaluative": 0.10, "exploratory": 0.05, "descriptive": 0.05}


def rank_questions(questions: DataFrame, relevance: float = 0.6, diversity: float = 0.4) -> DataFrame:
    """questions (pos, question, rationale, hints, style, gap_type) with relevance, diversity, combined and place."""
    n = F.length("question")
    style = F.coalesce(F.try_element_at(F.create_map(*[x for s, v in STYLES.items() for x in (F.lit(s), F.lit(v))]), F.col("style")), F.lit(0.0))
    score = (
        0.3
        + F.when(F.endswith("question", F.lit("?")), 0.2).otherwise(0.0)
        + F.when(has("rationale"), 0.2).otherwise(0.0)
        + F.when(has("hints"), 0.1).otherwise(0.0)
        + F.when(n.between(50, 200), 0.2).when(n.between(30, 250), 0.1).otherwise(0.0)
        + style
    )
    rare = lambda c: 1 / F.count("*").over(Window.partitionBy(c))
    out = questions.withColumn("relevance", F.least(score, F.lit(1.0))).withColumn("diversity", (rare("gap_type") + rare("style")) / 2)
    out = out.withColumn("combined", F.col("relevance") * relevance + F.col("diversity") * diversity)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.round("combined", 12).desc(), "pos")))


#: Titles that scanners and exports give, titles of what is no publication, and titles of government and policy reports; in order.
GARBLED = ("^KMBT_", "^214ps", "^Scannable Document", "^Scanned using", "^pdf$", r"^\d+$", "^__$")
NO_PUBLICATION = (
    r"^cc\d", r"^Activity \d", "concept map", "^DRAFT ", "PROGRESS REPORT", "Template-", "cheatsheet", r"\.docx?$", r"\.pptx?$", r"\.jpg$", "ACFT-Score", "ARTIFACT ARCHIVE",
    "User Agreement", "biosketch", "^annotated-", "^bisht ", "^moore ", "Learning Outcomes", "CHECKLIST", "Recruitment-Script", "STAC ActionPlan", "Score-Cart", "File Styles", "Knitting Tips",
)
GOVERNMENT = (
    "GAO", "ODNI", "NCSC", "FAA", "Biden", "White House", "National Strategy", r"CALL \d", "Army", "Defense", "Strategic Guidance", "Threat Assessment", "NAS Roadmap",
    "Rule Part 107", "DOD", "Emerging Tech.*Factsheet",
)


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(patterns)


def triage(title: Column | str, doi: Column | str) -> Column:
    """Repair category of an item: A has a DOI, E a garbled title, D is no publication, C a government report, B the rest."""
    t = F.coalesce(col(title), F.lit(""))
    known = F.coalesce(col(doi), F.lit("")) != ""
    return F.when(known, "A").when(t.rlike(any_of(GARBLED)), "E").when(t.rlike(any_of(NO_PUBLICATION)), "D").when(t.rlike(any_of(GOVERNMENT)), "C").otherwise("B")


#: How model names of a provider begin, and which provider is asked after which.
MODEL_STARTS = {"anthropic": ("claude",), "openai": ("gpt-", "o1", "o3", "o4"), "google": ("gemini",), "ollama": ("llama", "qwen", "mistral")}
OPPOSITES = {"anthropic": "openai", "openai": "anthropic"}


def provider_of(model: Column | str) -> Column:
    """The provider of a model name; `synthesis:` names one itself, as far as it serves by name. Others null."""
    m = F.lower(F.trim(col(model)))
    named = F.substring(m, len("synthesis:") + 1, 100)
    out = F.when(m.startswith("synthesis:"), F.when(named.isin("anthropic", "openai", "google"), named))
    for provider, starts in MODEL_STARTS.items():
        out = out.when(m.rlike("^(" + "|".join(starts) + ")"), provider)
    return out


def gap_fill_provider(extraction_model: Column | str, model: Column | str, filled_by: Column | str, override: str | None = None) -> Column:
    """Who fills an answer's gaps: the opposite of the provider that gave the answer (its extraction's model, else the entry's), else of the one that filled it before, else anthropic."""
    if override:
        return F.lit(override)
    opposite = F.create_map(*[F.lit(x) for kv in OPPOSITES.items() for x in kv])
    return F.coalesce(opposite[provider_of(F.coalesce(col(extraction_model), col(model)))], opposite[col(filled_by)], F.lit("anthropic"))


def validation_issues(confidence: Column, answered: Column, missing_required: Column, title_share: Column) -> Column:
    """Issues of an extraction, in order."""
    return F.array_compact(F.array(F.when(missing_required > 0, F.lit("missing_required")), F.when(confidence < 0.5, F.lit("low_confidence")).when(confidence < 0.7, F.lit("medium_confidence")), F.when(answered < 5, F.lit("few_dimensions")), F.when(title_share < 0.3, F.lit("title_mismatch"))))


#: The dimensions that an extraction of each document type must have, and those it should have.
TYPE_FIELDS = {
    "research_paper": ("q02_thesis q07_methods q04_evidence", "q01_research_question q22_contribution"),
    "review_paper": ("q02_thesis q03_key_claims", "q07_methods q22_contribution"),
    "book_monograph": ("q02_thesis q03_key_claims", "q22_contribution q21_summary"),
    "thesis": ("q02_thesis q07_methods q04_evidence q01_research_question", "q22_contribution q05_limitations"),
    "report": ("q04_evidence q22_contribution", "q03_key_claims"),
    "reference_material": ("q17_field q22_contribution", "q02_thesis"),
    "non_academic": ("", "keywords"),
}


def title_containment(title: Column | str, text: Column | str) -> Column:
    """Share of a title's words that a text's first 1000 characters hold; 1 where there is no text, no title or too short a title."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    t = words(F.coalesce(col(title), F.lit("")))
    both = F.size(F.array_intersect(t, words(F.substring(col(text), 1, 1000)))) / F.size(t)
    return F.when(col(text).isNull() | F.coalesce(col(title) == "Untitled", F.lit(True)) | (F.size(t) < 3), 1.0).otherwise(both)


def validate_extraction(dims: Column | str, document_type: Column | str, confidence: Column | str, claims: Column | str, title: Column | str, text: Column | str, min_confidence: float = 0.5) -> Column:
    """valid, issues, warnings, answered of an extraction (dims: dimension -> answer) by the rules of its document type; unknown and missing types as research papers, and
    without a type key claims are required too."""
    kind = F.when(col(document_type).isin(list(TYPE_FIELDS)), col(document_type)).otherwise("research_paper")
    named = sorted({f for pair in TYPE_FIELDS.values() for part in pair for f in part.split()})
    filled = lambda f: F.trim(F.coalesce(dimension_value(dims, f), F.lit(""))) != ""
    has = F.create_map(*[c for f in named for c in (F.lit(f), filled(f))])
    lists = lambda i: F.create_map(*[c for k, v in TYPE_FIELDS.items() for c in (F.lit(k), F.array(*map(F.lit, v[i].split())).cast("array<string>"))])[kind]
    missing = lambda i, what: F.transform(F.filter(lists(i), lambda f: ~has[f]), lambda f: F.concat(F.lit(f"missing {what}: "), f))
    score = F.coalesce(col(confidence).cast("double"), F.lit(0.0))
    answered = F.size(F.filter(F.array(*[filled(d) for d, _ in DIMENSIONS]), lambda x: x))
    one = lambda cond, what: F.when(cond, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    no_claims = col(document_type).isNull() & (F.trim(F.coalesce(col(claims), F.lit(""))) == "")
    issues = F.concat(one(title_containment(title, text) < 0.3, "title mismatch"), one(score < min_confidence, "confidence too low"), missing(0, "required"), one(no_claims, "missing key claims"))
    warnings = F.concat(one(score < 0.7, "low confidence"), missing(1, "recommended"), one(answered < 5, "few dimensions"))
    return F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues"), warnings.alias("warnings"), answered.alias("answered"))
