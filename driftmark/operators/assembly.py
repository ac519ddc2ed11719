"""Entity records from landed resource tables, by reference joins.

Inputs are tables `(pos, resource VARIANT)`, one per resource kind, `pos` being the landing order.
The children of a record (texts, prices, sources, ...) are produced as flat tables keyed by
`entity_id`; `nest_records` folds them into one document per entity for the snapshot store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark import presets
from driftmark.functions import text as X
from driftmark.functions import times as D
from driftmark.functions import variant as V
from driftmark.operators import identity as I
from driftmark.operators.skew import lookup_join

ITEM_PATH = r"^item\.\d+(\.item\.\d+)*$"


# ---- scalars of one resource -------------------------------------------------------------------------


def identifier_value(resource: Column, name: str = presets.ENTITY_IDENTIFIER, width: int = presets.ENTITY_ID_WIDTH) -> Column:
    """Value of the first identifier whose system ends in `/name`, padded with zeros, never cut."""
    hits = F.filter(
        V.as_list(V.member(resource, "identifier")),
        lambda i: F.endswith(F.regexp_replace(F.coalesce(V.at(i, "system"), F.lit("")), "/+$", ""), F.lit("/" + name)),
    )
    value = V.at(F.try_element_at(hits, F.lit(1)), "value")
    return pad_id(value, width)


def pad_id(value: Column, width: int = presets.ENTITY_ID_WIDTH) -> Column:
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def id_from_url(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def organization_name(resource: Column) -> Column:
    aliases = F.transform(V.as_list(V.member(resource, "alias")), V.as_text)
    return F.coalesce(
        X.first_text(V.text_at(resource, "name"), V.text_at(resource, "alias")), X.first_item_text(F.array_compact(aliases))
    )


def infer_status(text: Column, validity_end: Column) -> Column:
    """Status by keywords anywhere in the resource text, keys included; the first rule that hits wins."""
    lowered = F.lower(text)
    choice = None
    for status, words in presets.STATUS_RULES:
        hit = X.contains_any(lowered, words)
        choice = F.when(hit, F.lit(status)) if choice is None else choice.when(hit, F.lit(status))
    ended = F.coalesce(validity_end, F.lit("")) != ""
    return choice.when(ended, F.lit("removed")).otherwise(F.lit("listed"))


def is_description(path: Column, text: Column) -> Column:
    """Long enough text under a path that names a description."""
    return (F.length(X.strip(text)) >= presets.DESCRIPTION_MIN_CHARS) & X.contains_any(F.lower(path), presets.DESCRIPTION_MARKERS)


# ---- references ------------------------------------------------------------------------------------------


def references(df: DataFrame, doc: str, keys: Sequence[str], prefix: str = presets.DEVICE_REFERENCE) -> DataFrame:
    """All references with the prefix inside a document: `(keys, pos_in_doc, reference)`."""
    nodes = V.walk(df.select(*keys, doc), doc)
    reference = V.text_at(F.col("node"), "reference")
    return nodes.select(*keys, F.col("node_pos").alias("pos_in_doc"), reference.alias("reference")).filter(
        F.startswith("reference", F.lit(prefix))
    )


def first_reference(df: DataFrame, doc: str, keys: Sequence[str], prefix: str = presets.DEVICE_REFERENCE) -> DataFrame:
    found = references(df, doc, keys, prefix)
    return found.groupBy(*keys).agg(F.min_by("reference", "pos_in_doc").alias("reference"))


def join_first_match(left: DataFrame, right: DataFrame, key: str, position: str, how: str = "inner", salt_by: Sequence[str] = ()) -> DataFrame:
    """Many-to-one join to the first right row of each key; popular keys are spread."""
    rest = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(position)).alias("__r"))
    return lookup_join(left, first.select(key, "__r.*").drop(position), [key], how, salt_by=salt_by)


def units_by_parent(modules: DataFrame, units: DataFrame, parent: str, module_ref: str) -> DataFrame:
    """Units of a parent through its modules: `units` has one row per distinct `(unit, module_ref)`.

    A unit on two modules of one parent appears twice, as in the source data model.
    """
    return lookup_join(units, modules.select(module_ref, parent), [module_ref], "inner")


def backfill(records: DataFrame, directory: DataFrame, key: str, stub: dict[str, Column]) -> DataFrame:
    """Directory ids without a record get a stub row."""
    missing = directory.join(records.select(key), key, "left_anti")
    return records.unionByName(missing.select("*", *[c.alias(n) for n, c in stub.items()]), allowMissingColumns=True)


def source_updates(*relations: DataFrame) -> DataFrame:
    """Union of `(entity_id, source, last_updated)` candidates without empty times."""
    out = relations[0]
    for relation in relations[1:]:
        out = out.unionByName(relation)
    return out.filter(F.coalesce(F.col("last_updated"), F.lit("")) != "")


def latest_update(candidates: DataFrame, key: str = "entity_id", by: str = "text") -> DataFrame:
    """Latest candidate time per entity: `text` compares the strings, `time` the instants they name."""
    rank = F.col("last_updated") if by == "text" else D.parse_time(F.col("last_updated"))
    return candidates.groupBy(key).agg(
        F.max_by("last_updated", rank).alias("last_updated_at"), F.count(F.lit(1)).alias("checked_sources")
    )


# ---- questionnaires --------------------------------------------------------------------------------------------


def _items(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    nodes = V.walk(df.select(*keys, "resource"), "resource")
    return nodes.filter(F.array_join("path", ".").rlike(ITEM_PATH))


def question_labels(questionnaires: DataFrame) -> DataFrame:
    """`(url, link_id, label)`; the last questionnaire of a url and the last item of a link id win."""
    url = V.at(F.col("resource"), "url")
    named = questionnaires.select(url.alias("url"), "pos", "resource").filter(X.truthy(F.col("url")).isNotNull())
    latest = I.latest_per_key(named, ["url"], ["pos"])
    items = _items(latest, ["url"])
    link, label = I.truthy_text(V.member(F.col("node"), "linkId")), I.truthy_text(V.member(F.col("node"), "text"))
    rows = items.select("url", link.alias("link_id"), X.clean_text(label).alias("label"), F.col("node_pos").alias("at"))
    return I.latest_per_key(rows.filter("link_id is not null and label is not null"), ["url", "link_id"], ["at"]).drop("at")


def _answer_parts(answer: Column) -> Column:
    def part(value: Column) -> Column:
        flat = F.schema_of_variant(value).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        pieces = F.array(
            I.truthy_text(V.member(value, "text")),
            I.truthy_text(V.member(value, "display")),
            I.truthy_text(V.at(value, "coding.0.display", "variant")),
            I.truthy_text(V.at(value, "coding.0.code", "variant")),
        )
        return (
            F.when(F.schema_of_variant(value) == "BOOLEAN", F.array(F.initcap(value.try_cast("string"))))
            .when(flat, F.array(value.try_cast("string")))
            .when(V.as_object(value).isNotNull(), F.array_compact(pieces))
            .otherwise(F.array().cast("array<string>"))
        )

    members = F.filter(F.map_entries(V.as_object(answer)), lambda e: F.startswith(e["key"], F.lit("value")))
    return F.flatten(F.transform(members, lambda e: part(e["value"])))


def questionnaire_answers(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`(keys, questionnaire, item_pos, link_id, text)` of every answered item."""
    items = _items(responses.withColumn("questionnaire", V.at(F.col("resource"), "questionnaire")), [*keys, "questionnaire"])
    parts = F.flatten(F.transform(V.as_list(V.member(F.col("node"), "answer")), _answer_parts))
    link = F.coalesce(I.truthy_text(V.member(F.col("node"), "linkId")), F.lit("unknown"))
    rows = items.select(
        *keys, "questionnaire", F.col("node_pos").alias("item_pos"), link.alias("link_id"), X.clean_text(F.array_join(parts, " ")).alias("text")
    )
    return rows.filter("text <> ''")


def labelled_answers(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers with their question text, the link id where the questionnaire has none."""
    dim = labels.withColumnRenamed("url", "questionnaire")
    joined = lookup_join(answers.withColumn("questionnaire", F.coalesce("questionnaire", F.lit(""))), dim, ["questionnaire", "link_id"], "left")
    return joined.withColumn("label", F.coalesce("label", "link_id"))


# ---- records --------------------------------------------------------------------------------------------------------


def assemble(resources: dict[str, DataFrame], directory: DataFrame, by: str = "text", timezone: str = presets.DISPLAY_TIMEZONE) -> dict[str, DataFrame]:
    """All tables of the assembled registry, from resource tables and `(entity_id, entity_url)`.

    Returns `records` (one header row per record) and the child tables `texts`, `evidence`,
    `history`, `prices`, `indications`, `sources`, `updates`, `modules`, `units`.
    """
    res = F.col("resource")
    catalog = resources["catalog_entries"].select(F.col("pos").alias("catalog_pos"), "resource")
    apps = resources["health_apps"].select(
        F.concat(F.lit(presets.DEVICE_REFERENCE), V.at(res, "id")).alias("app_ref"), "pos", res.alias("app")
    )
    refs = first_reference(catalog, "resource", ["catalog_pos"]).withColumnRenamed("reference", "app_ref")
    matched = join_first_match(refs, apps, "app_ref", "pos", salt_by=["catalog_pos"])
    entity = F.coalesce(identifier_value(F.col("app")), I.truthy_text(V.member(F.col("app"), "id")))
    entries = matched.join(catalog.withColumnRenamed("resource", "entry"), "catalog_pos").withColumn("entity_id", entity)
    entries = entries.filter("entity_id is not null")
    makers = resources["manufacturers"].select(
        F.concat(F.lit(presets.ORGANIZATION_REFERENCE), V.at(res, "id")).alias("maker_ref"), (-F.col("pos")).alias("back"), res.alias("maker")
    )
    entries = entries.withColumn("maker_ref", F.coalesce(V.text_at(F.col("app"), "manufacturerReference.reference"), F.lit("")))
    entries = join_first_match(entries, makers, "maker_ref", "back", "left", salt_by=["catalog_pos"])
    urls = directory.select("entity_id", "entity_url")
    app, entry = F.col("app"), F.col("entry")
    header = lookup_join(
        entries.select(
            "entity_id", "catalog_pos", "app_ref", "app", "entry", "maker",
            X.first_text(V.text_at(app, "deviceName.0.name"), V.text_at(app, "name"), V.text_at(app, "title")).alias("name"),
            organization_name(F.col("maker")).alias("manufacturer"),
            infer_status(F.to_json(entry), V.at(entry, "validityPeriod.end")).alias("status"),
            V.at(entry, "id").alias("catalog_entry_id"),
            V.at(app, "id").alias("health_app_id"),
        ),
        urls, ["entity_id"], "left", salt_by=["catalog_pos"],
    )
    full = header.withColumn(
        "entity_url", F.coalesce("entity_url", F.format_string(presets.DIRECTORY_URL_TEMPLATE, F.col("entity_id")))
    )
    # Two catalog entries of one entity: the later record replaces the earlier one, children included.
    full = I.latest_per_key(full, ["entity_id"], ["catalog_pos"])
    owner = full.select("entity_id", "app_ref")

    def by_app(kind: str, path: str) -> DataFrame:
        rows = resources[kind].select(V.text_at(res, path).alias("app_ref"), "pos", "resource")
        return lookup_join(rows.filter("app_ref is not null"), owner, ["app_ref"], "inner", salt_by=["pos"])

    modules = by_app("modules", "parentDevice.reference").select(
        "entity_id", "pos", V.at(res, "id").alias("module_id"), V.at(res, "meta.lastUpdated").alias("last_updated")
    )
    responses = by_app("questionnaire_responses", "subject.reference")
    unit_refs = references(resources["prescription_units"], "resource", ["pos"]).select("pos", F.col("reference").alias("module_ref")).distinct()
    parents = modules.select(
        F.concat(F.lit(presets.DEVICE_REFERENCE), "module_id").alias("module_ref"), "entity_id", F.col("pos").alias("module_pos")
    )
    owned = lookup_join(unit_refs, parents, ["module_ref"], "inner", salt_by=["pos"])
    units = lookup_join(owned, resources["prescription_units"].select("pos", "resource"), ["pos"], "inner", salt_by=["module_ref"])

    labels = question_labels(resources["questionnaires"])
    answers = labelled_answers(questionnaire_answers(responses, ["entity_id", "pos"]), labels)
    answer_texts = answers.select(
        "entity_id", F.concat(F.lit(presets.QUESTIONNAIRE_PREFIX), "label").alias("key"), "text", F.struct("pos", "item_pos").alias("at")
    )
    texts = I.latest_per_key(answer_texts, ["entity_id", "key"], ["at"]).drop("at")
    for prefix, doc in (("health_app.", "app"), ("catalog_entry.", "entry")):
        leaves = V.text_leaves(full.select("entity_id", doc), doc)
        path = F.array_join("path", ".")
        texts = texts.unionByName(
            leaves.filter(is_description(path, F.col("text"))).select(
                "entity_id", F.concat(F.lit(prefix), path).alias("key"), X.clean_text(F.col("text")).alias("text")
            )
        )
    lowered = F.lower("label")
    evidence = answers.filter(
        ~F.contains(lowered, F.lit(presets.EVIDENCE_EXCLUDED)) & X.contains_any(lowered, presets.EVIDENCE_KEYWORDS)
    ).select("entity_id", "pos", "item_pos", F.concat_ws(": ", "label", "text").alias("part"))
    last = lambda doc: V.at(F.col(doc), "meta.lastUpdated").alias("last_updated")
    named = lambda prefix, id_: F.concat_ws(".", F.lit(prefix), F.coalesce(id_, F.lit("None"))).alias("source")
    sources = source_updates(
        full.select("entity_id", F.lit("catalog_entry").alias("source"), last("entry")),
        full.select("entity_id", F.lit("health_app").alias("source"), last("app")),
        full.select("entity_id", F.lit("manufacturer").alias("source"), last("maker")),
        modules.select("entity_id", named("module", F.col("module_id")), "last_updated"),
        responses.select("entity_id", named("questionnaire_response", V.at(res, "id")), last("resource")),
        units.select("entity_id", named("prescription_unit", V.at(res, "id")), last("resource")),
    )
    updates = latest_update(sources, by=by).withColumn("notice_text", D.update_notice(F.col("last_updated_at"), timezone))
    return {
        "records": full.drop("app", "entry", "maker", "app_ref"),
        "texts": texts,
        "evidence": evidence,
        "history": change_history(full.select("entity_id", "entry")),
        "prices": price_information(units),
        "indications": indications(units),
        "sources": sources,
        "updates": updates,
        "modules": modules,
        "units": units.select("entity_id", "module_pos", "pos", V.at(res, "id").alias("unit_id")),
    }


def change_history(entries: DataFrame) -> DataFrame:
    """Rows of the history extension: `(entity_id, position, date, title, type, type_display, remark, text)`."""
    with_url = lambda doc, url: F.filter(V.as_list(V.member(doc, "extension")), lambda e: V.at(e, "url") == url)
    history = F.try_element_at(with_url(F.col("entry"), presets.HISTORY_EXTENSION), F.lit(1))
    rows = entries.select("entity_id", F.posexplode(with_url(history, presets.HISTORY_CHILD)).alias("position", "child"))

    def field(name: str) -> Column:
        return F.try_element_at(with_url(F.col("child"), name), F.lit(-1))

    date = X.first_text(V.text_at(field("date"), "valueDateTime"))
    code, shown = V.at(field("type"), "valueCoding.code"), V.at(field("type"), "valueCoding.display")
    title = X.first_text(V.text_at(field("title"), "valueString"), shown, code)
    remark = X.first_text(V.text_at(field("remark"), "valueString"))
    return rows.select(
        "entity_id", "position", date.alias("date"), title.alias("title"), code.alias("type"), shown.alias("type_display"),
        remark.alias("remark"), X.clean_text(F.concat_ws(" ", date, title, remark)).alias("text"),
    )


def price_information(units: DataFrame) -> DataFrame:
    """One price row per unit and referencing module, with the distinct sorted texts that speak of money."""
    res = F.col("resource")
    keys = ["entity_id", "module_pos", "pos"]
    leaves = V.text_leaves(units.select(*keys, "resource"), "resource")
    euro, code, word = presets.PRICE_TEXT_MARKERS
    money = F.contains("text", F.lit(euro)) | F.contains(F.upper("text"), F.lit(code)) | F.contains(F.lower("text"), F.lit(word))
    said = leaves.filter(money).groupBy(*keys).agg(F.array_sort(F.collect_set(X.clean_text(F.col("text")))).alias("text"))
    components = F.coalesce(
        *[F.when(I.truthy_text(V.member(res, n)).isNotNull(), V.member(res, n)) for n in ("propertyGroup", "priceComponent")],
        F.parse_json(F.lit("[]")),
    )
    rows = units.select(
        *keys, V.at(res, "title").alias("title"), V.member(res, "effectivePeriod").alias("effective_period"), components.alias("price_components")
    )
    return rows.join(said, keys, "left")


def indications(units: DataFrame) -> DataFrame:
    """Distinct codings of the units that look like diagnosis codes: `(entity_id, indication, at)`."""
    keys = ["entity_id", "module_pos", "pos"]
    nodes = V.walk(units.select(*keys, "resource"), "resource")
    node = F.col("node")
    own = F.when(
        F.map_contains_key(V.as_object(node), F.lit("code")) & F.map_contains_key(V.as_object(node), F.lit("display")), F.array(node)
    )
    listed = F.filter(V.as_list(V.member(node, "coding")), lambda c: V.as_object(c).isNotNull())
    empty = F.array().cast(V.LIST)
    codings = nodes.select(
        "entity_id", F.struct("module_pos", "pos", "node_pos").alias("at"),
        F.posexplode(F.concat(F.coalesce(own, empty), F.coalesce(listed, empty))).alias("n", "coding"),
    )
    code = F.coalesce(I.truthy_text(V.member(F.col("coding"), "code")), F.lit(""))
    shown = F.concat_ws(" ", code, I.truthy_text(V.member(F.col("coding"), "display")))
    rows = codings.filter(code.rlike(r"^[A-Z]\d")).select("entity_id", shown.alias("indication"), F.struct("at", "n").alias("at"))
    return rows.groupBy("entity_id", "indication").agg(F.min("at").alias("at"))


def text_sections(texts: DataFrame) -> DataFrame:
    """Routed section rows of description texts `(entity_id, key, text)`."""
    key = F.col("key")
    questionnaire = F.startswith(key, F.lit(presets.QUESTIONNAIRE_PREFIX))
    tail = F.when(F.contains(key, F.lit(".")), F.regexp_replace(key, r"^[^.]*\.", "")).otherwise(key)
    raw = F.when(questionnaire, F.regexp_replace(key, r"^questionnaire\.", "")).otherwise(F.replace(tail, F.lit("_"), F.lit(" ")))
    label = X.question_label(raw)
    own = F.startswith(key, F.lit("health_app.")) | F.startswith(key, F.lit("catalog_entry."))
    section = (
        F.when(questionnaire, X.route_section(raw)).when(own, F.lit(presets.SECTION_DEFAULT)).otherwise(F.lit(presets.UNASSIGNED_SECTION))
    )
    subsection = F.coalesce(X.truthy(label), F.lit(presets.UNASSIGNED_SECTION))
    shown = F.filter(F.array(section, subsection), lambda p: p != presets.UNASSIGNED_SECTION)
    path = F.when(F.size(shown) > 0, F.array_join(shown, " > ")).otherwise(F.lit(presets.UNASSIGNED_SECTION))
    parts = F.filter(F.array(F.lit("descriptive_texts"), section, section, label, key), lambda p: p != "")
    return texts.select(
        "entity_id",
        F.concat(F.lit(presets.DESCRIPTION_PREFIX), key).alias("field_path"),
        F.array_join(F.transform(parts, X.stable_key_part), "|").alias("stable_key"),
        section.alias("main_section"),
        section.alias("tab_label"),
        section.alias("accordion_title"),
        section.alias("source_area_label"),
        section.alias("section_title"),
        subsection.alias("subsection_title"),
        label.alias("question_label"),
        label.alias("field_label"),
        path.alias("display_path"),
        F.when(label != "", F.lit("high")).otherwise(F.lit("low")).alias("localization_confidence"),
        F.col("text").alias("raw_text"),
        "text",
    )


def nest_records(tables: dict[str, DataFrame]) -> DataFrame:
    """`(entity_id, doc VARIANT)`: header and children of each entity as one registry document.

    A document is one row by definition, so this is for entities whose children fit a row; tables
    with larger ones are compared in their flat form.
    """

    def listed(df: DataFrame, name: str, order: Sequence[str], value: Column) -> DataFrame:
        packed = df.select("entity_id", F.struct(F.struct(*order).alias("o"), value.alias("v")).alias("x"))
        gathered = packed.groupBy("entity_id").agg(F.collect_list("x").alias("xs"))
        ordered = F.array_sort("xs", lambda l, r: F.when(l["o"] < r["o"], -1).when(l["o"] > r["o"], 1).otherwise(0))
        return gathered.select("entity_id", F.transform(ordered, lambda x: x["v"]).alias(name))

    texts = tables["texts"].groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("texts"))
    sections = text_sections(tables["texts"])
    section_struct = F.struct(*[c for c in sections.columns if c != "entity_id"])
    history_cols = ["date", "title", "type", "type_display", "remark", "text"]
    price = F.struct("title", "effective_period", "price_components", "text")
    sources = listed(
        tables["sources"].withColumn("neg", -F.unix_micros(D.parse_time(F.col("last_updated")))), "checked_sources", ["neg", "source"],
        F.struct("source", "last_updated"),
    )
    children = [
        texts,
        listed(sections, "sections", ["field_path"], section_struct),
        listed(tables["evidence"], "evidence_parts", ["pos", "item_pos"], F.col("part")),
        listed(tables["history"], "change_history", ["position"], F.struct(*history_cols)),
        listed(tables["prices"], "pricing_information", ["module_pos", "pos"], price),
        listed(tables["indications"], "indication", ["at"], F.col("indication")),
        sources,
        tables["updates"].select("entity_id", "last_updated_at", "notice_text"),
        listed(tables["modules"], "module_ids", ["pos"], F.col("module_id")),
        listed(tables["units"], "prescription_unit_ids", ["module_pos", "pos"], F.col("unit_id")),
    ]
    joined = tables["records"]
    for child in children:
        joined = joined.join(child, "entity_id", "left")
    def items(name: str) -> Column:
        kind = dict(joined.dtypes)[name]
        return F.coalesce(F.col(name), F.array().cast(kind))
    doc = F.struct(
        F.col("entity_id").alias("id"), "name", "manufacturer", "status", items("indication").alias("indication"),
        F.col("entity_url").alias("bfarm_directory_url"),
        F.map_from_entries(items("texts")).alias("descriptive_texts"),
        items("sections").alias("structured_text_sections"),
        X.truthy(X.clean_text(F.array_join("evidence_parts", " "))).alias("evidence_summary_text"),
        items("change_history").alias("change_history"),
        items("pricing_information").alias("pricing_information"),
        F.struct(
            "last_updated_at", "notice_text", F.lit(presets.DATA_NOTICE).alias("data_notice"), items("checked_sources").alias("checked_sources")
        ).alias("source_update_notice"),
        F.struct(
            "catalog_entry_id", "health_app_id", items("module_ids").alias("module_ids"), items("prescription_unit_ids").alias("prescription_unit_ids")
        ).alias("raw_public_fhir"),
    )
    return joined.select("entity_id", F.to_variant_object(doc).alias("doc"))


def stub_document(entity_id: Column, entity_url: Column) -> Column:
    """Document of an id that is listed in the directory but has no resources."""
    empty = F.array().cast("array<string>")
    return F.to_variant_object(
        F.struct(
            entity_id.alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("manufacturer"),
            F.lit(presets.STUB_STATUS).alias("status"), empty.alias("indication"), entity_url.alias("bfarm_directory_url"),
            F.create_map().cast("map<string,string>").alias("descriptive_texts"), empty.alias("structured_text_sections"),
            F.lit(None).cast("string").alias("evidence_summary_text"), empty.alias("change_history"), empty.alias("pricing_information"),
            F.struct(
                F.lit(None).cast("string").alias("last_updated_at"), F.lit(None).cast("string").alias("notice_text"),
                F.lit(presets.DATA_NOTICE).alias("data_notice"), empty.alias("checked_sources"),
            ).alias("source_update_notice"),
            F.lit(presets.STUB_SOURCE).alias("source"),
        )
    )


def registry_documents(resources: dict[str, DataFrame], directory: DataFrame, **options) -> DataFrame:
    """Documents of all records, and stubs for directory ids without one."""
    docs = nest_records(assemble(resources, directory, **options))
    missing = directory.join(docs.select("entity_id"), "entity_id", "left_anti")
    return docs.unionByName(missing.select("entity_id", stub_document(F.col("entity_id"), F.col("entity_url")).alias("doc")))
