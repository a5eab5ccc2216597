"""Column shaping: renames, payload decoding, partition columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.calendar import parts_of
from emberline.schema import PARTS, PAYLOAD_FIELDS

# Source and target column names of the event feed, in order. Two
# sources may share a target.
RENAMES = (
    "clientid-client_id,gpscountry-country,gpsstate-state,gpscity-city,"
    "user_app_ver-app_ver,user_connection-connection_type,user_os_ver-os_ver,"
    "user_languages-user_language,uniqueid-unique_id,cellid-cell_id,"
    "adgroupid-ad_group_id,audiencesegments-audience_segments,"
    "resolution-device_resolution,hostalias-hostname,locationsource-location_src,"
    "partnerid-partner_id,deliveryslab-delivery_slab,"
    "userdeliveryslab-user_delivery_slab,nthimpression-nth_impression,"
    "utmsource-utm_source,utmmedium-utm_medium,utmcampaign-utm_campaign,"
    "installdeliveryslab-install_delivery_slab,installcpi-install_cpi,"
    "optimisedby-optimised_on,topcampaignids-top_campaign_ids,"
    "topcampaignecpms-top_campaign_ecpms,"
    "predictedinstallprobability-predicted_install_probability,"
    "campaignprdictedctr-campaign_predicted_ctr,promovdoid-promovdo_id,"
    "promotopic-promo_topic,topicid-topic_id,topicname-topic_name,"
    "dhtvchannelid-dhtv_channel_id,dhtvtype-dhtv_type,"
    "buzzcontentpartner-buzz_content_partner,dhtvsourcekey-dhtv_source_key,"
    "dhtvrelevance-dhtv_relevance,dhtvurgency-dhtv_urgency,"
    "dhtvpartyleaning-dhtv_party_leaning,pubname-pubname,vdogroupkey-vdogroupkey,"
    "articleid-article_id,autoplaypref-autoplaypref,"
    "secondbiddercampaign-second_bidder_campaign,"
    "secondbidderecpm-second_bidder_ecpm,entityid-entity_id,entitytype-entity_type,"
    "entitysubtype-entity_subtype,contentcontext-contentcontext,"
    "parentcontentcontext-parentcontentcontext,productids-product_ids,"
    "recopolicy-recopolicy,et_year-event_year,et_month-event_month,"
    "et_day-event_day,et_hour-event_hour,appid-install_campaign_app_id,"
    "app_id-install_campaign_app_id"
)

# The older schema on the left, current names on the right.
LEGACY_NAMES = {
    "properties_et_year": "event_year",
    "properties_et_month": "event_month",
    "properties_et_day": "event_day",
    "properties_et_hour": "event_hour",
    "properties_impression_count": "has_impression",
    "properties_click_count": "has_click",
    "properties_has_request": "has_request",
    "properties_has_response": "has_response",
    "properties_has_install": "has_install",
    "properties_has_lead": "has_lead",
    "properties_has_postinstall": "has_postinstall",
    "properties_has_vast": "has_vast",
    "properties_has_ad_interactions": "has_ad_interactions",
}


def mapped_targets(spec: str = RENAMES) -> list[str]:
    """Target names of the mapped fields, without the key and the partition tuple."""
    targets = dict.fromkeys(pair.strip().split("-", 1)[1] for pair in spec.split(","))
    return [name for name in targets if name not in {"unique_id", *PARTS}]


def mapped_fields(spec: str = RENAMES) -> dict[str, tuple[str, str]]:
    """Payload fields that are mapped, as `parse` takes them: each under its own name."""
    kept = set(mapped_targets(spec))
    pairs = [pair.strip().split("-", 1) for pair in spec.split(",")]
    return {source: (source, "string") for source, target in pairs if target in kept}


def details_of(held: str, spec: str = RENAMES) -> str:
    """SQL for the mapped fields of a decoded struct, renamed, as one JSON object; NULL when there are none.

    One expression, so that a plan carries one column and not one for every field.
    """
    fields = [f"'{target}', coalesce({', '.join(f'{held}.`{name}`' for name in names)})" for target, names in renamed(list(mapped_fields(spec)), spec)]
    return f"nullif(to_json(named_struct({', '.join(fields)}), map('ignoreNullFields', 'true')), '{{}}')"


def renamed(names: list[str], spec: str = RENAMES) -> list[tuple[str, list[str]]]:
    """Names after `rename`, each with the columns it is taken from, of which the first non-null one counts."""
    sources: dict[str, list[str]] = {}
    for pair in spec.split(","):
        source, target = pair.strip().split("-", 1)
        sources.setdefault(target, []).append(source.lower())
    present = {name.lower(): name for name in names}
    target_of = {source: target for target, group in sources.items() for source in group}

    out: list[tuple[str, list[str]]] = []
    done: set[str] = set()
    for name in names:
        target = target_of.get(name.lower())
        if target is None:
            out.append((name, [name]))
        elif target not in done:
            done.add(target)
            out.append((target, [present[s] for s in sources[target] if s in present]))
    return out


def rename(df: DataFrame, spec: str = RENAMES) -> DataFrame:
    """Apply `source-target` pairs in one projection.

    Source names match without regard to case; unmapped columns keep their names
    and places. When several sources of a target are present, the first non-null one
    in spec order wins, and it stands where the first of them stood.
    """
    out: list[Column] = []
    for target, names in renamed(df.columns, spec):
        held = [F.col(name) for name in names]
        out.append((F.coalesce(*held) if len(held) > 1 else held[0]).alias(target))
    return df.select(*out)


def align_legacy(df: DataFrame) -> DataFrame:
    """Older `properties_*` columns to current names, flags and parts as integers."""
    return df.select(
        *[
            F.col(name).cast("int").alias(LEGACY_NAMES[name]) if name in LEGACY_NAMES else F.col(name)
            for name in df.columns
        ]
    )


def partition_last(df: DataFrame) -> DataFrame:
    """Other columns in their order, then the four partition columns."""
    return df.select(*[name for name in df.columns if name not in PARTS], *PARTS)


def with_partitions(df: DataFrame, ts_col: str = "request_ts") -> DataFrame:
    """Append the partition tuple of a time column.

    Partitioning on the request time keeps all events of a key together.
    """
    kept = [name for name in df.columns if name not in PARTS]
    return df.select(*kept, *parts_of(F.col(ts_col)))


def parse(df: DataFrame, fields: dict[str, tuple[str, str]] = PAYLOAD_FIELDS, details: str | None = None) -> DataFrame:
    """Decode `payload` JSON. `fields` maps a JSON field to (column, type).

    `details` names a column for the mapped fields, as one JSON object.

    Adds the typed columns, `corrupt` (the payload when it is not JSON) and
    `bad_value` (a field is there but not of its type). Other columns stay, except
    those a decoded column replaces.
    """
    decoded_fields = fields | mapped_fields() if details else fields
    text = ", ".join(f"`{field}` STRING" for field in decoded_fields)
    names = {column for column, _ in fields.values()}
    typed = {f: f"try_cast(_json.`{f}` AS {kind})" for f, (_, kind) in fields.items()}
    wrong = " OR ".join(
        f"(_json.`{f}` IS NOT NULL AND {typed[f]} IS NULL)"
        for f, (_, kind) in fields.items()
        if kind != "string"
    )
    decoded = F.from_json(
        "payload",
        f"{text}, _corrupt STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    # One decoded row per message comes out of `explode`, and filters on what was
    # decoded stay above it, so a message is decoded once.
    return df.select("*", F.explode(F.array(decoded)).alias("_json")).selectExpr(
        *[name for name in df.columns if name not in names],
        *[f"{typed[f]} AS {column}" for f, (column, _) in fields.items()],
        *([f"{details_of('_json')} AS {details}"] if details else []),
        "_json._corrupt AS corrupt",
        f"({wrong or 'false'}) AS bad_value",
    )
