"""Schemas of the document graph's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "concept": "id string not null, type string, title string, description string, resource string, tags array<string>, timestamp timestamp, body string, embedding array<float>, extra map<string,string>",
    "chunk": "id string not null, parent_doc_id string, chunk_index bigint, chunk_text string, block_type string, start_offset bigint, end_offset bigint, embedding array<float>",
    "image_asset": "id string not null, file_name string, mime_type string, alt_text string, caption string, embed_route string, content_hash string, embedding array<float>",
    "image_data": "id string not null, data binary",
    "includes_asset": "src string, dst string",
    "concept_posting": "term string, id string, tf bigint, dl int",
    "concept_length": "id string, dl int",
    "chunk_posting": "term string, id string, tf bigint, dl int",
    "chunk_length": "id string, dl int",
    "link_raw": "src string, target string",
    "adjacency": "node string, rel string, way string, other string, label string, n bigint",
    "hub": "id string, n bigint",
    "file_hash": "path string, hash string, concept_id string, size bigint, modified timestamp",
    "import_error": "path string, error string",
    "dir_hash": "path string, hash string, files array<string>, lanes array<bigint>, n bigint",
    "concept_cell": "id string, cell int, code array<smallint>, embedding array<float>",
    "chunk_cell": "id string, cell int, code array<smallint>, embedding array<float>",
    "cell_centre": "grain string, cell int, centre array<double>",
    "codebook": "grain string, part int, entry int, centre array<double>",
    "deleted_concept": "id string, original_id string, title string, body string, deleted_at timestamp, type string, tags array<string>",
}
#: The document of a chunk's id.
OF_CHUNK = "regexp_replace(id, '#chunk:[0-9]+$', '')"
#: What a change replaces, by table, in SQL.
KEYS = {
    "concept": "id",
    "chunk": "parent_doc_id",
    "image_asset": "id",
    "image_data": "id",
    "includes_asset": "src",
    "concept_posting": "id",
    "concept_length": "id",
    "chunk_posting": OF_CHUNK,
    "chunk_length": OF_CHUNK,
    "concept_cell": "id",
    "chunk_cell": OF_CHUNK,
    "cell_centre": "grain",
    "codebook": "grain",
    "link_raw": "src",
    "adjacency": "node",
    "hub": "id",
    "file_hash": "path",
    "dir_hash": "path",
    "import_error": "path",
    "deleted_concept": "id",
}
#: Tables of signed rows: the sum of ``n`` is what there is.
SUMMED = ("adjacency", "hub")
#: Version of the stored layout. Tables of older ones get the columns they lack, filled by ``MIGRATIONS``.
VERSION = 6
#: By table: (first version that needs it not, columns in SQL).
MIGRATIONS = {
    "concept_posting": (6, {"dl": "coalesce(dl, cast(sum(tf) over (partition by id) as int))"}),
    "chunk_posting": (6, {"dl": "coalesce(dl, cast(sum(tf) over (partition by id) as int))"}),
}
OFFICIAL_DIMENSIONS = (32, 64, 128, 256, 512, 768, 1024)


def schema(name: str) -> StructType:
    """The schema of a stored table."""
    return StructType.fromDDL(TABLES[name])


def checked_dimension(dim: int) -> int:
    """``dim`` if embeddings may have it."""
    if not 32 <= dim <= 1024:
        raise ValueError(f"embeddings have 32 to 1024 components, not {dim}")
    return dim


def migrated(df, name: str, version: int = VERSION):
    """A stored table in today's layout: columns it lacks are null or made from others, unknown ones stay behind."""
    from pyspark.sql import functions as F

    empty = df.sparkSession.createDataFrame([], schema(name))
    out = empty.unionByName(df, allowMissingColumns=True).select(*empty.columns)
    since, made = MIGRATIONS.get(name, (0, {}))
    return out.withColumns({c: F.expr(x) for c, x in made.items()}) if version < since else out
