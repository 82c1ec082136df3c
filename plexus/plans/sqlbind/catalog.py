"""The catalog as the binder sees it: objects, columns and routines by name, under a dialect's rules of letter case."""

from __future__ import annotations

from dataclasses import dataclass, field

from ...model import escape_text

UPPER = ("oracle", "db2", "h2")


def ascii_lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


class _Columns(dict):
    """Columns by object id; every id that is asked for is noted."""

    def __init__(self, touched: set[str]) -> None:
        super().__init__()
        self.touched = touched

    def get(self, key: str, default: object = None) -> object:
        self.touched.add(f"c|{key}")
        return super().get(key, default)


class _Schemas(set):
    def __init__(self, touched: set[str]) -> None:
        super().__init__()
        self.touched = touched

    def __contains__(self, key: object) -> bool:
        self.touched.add(f"s|{key}")
        return super().__contains__(key)


def name_key(part: str, schema: str, name: str) -> str:
    """The key under which a lookup and a catalog's name meet, the same for names that differ by letter case only."""
    return f"{part}|{schema.lower()}|{name.lower()}"


@dataclass
class Catalog:
    """``touched`` has the keys of all names that were looked up, found or not, since it was cleared."""

    dialect: str = ""
    database: str | None = None
    folds_relations: bool = False
    schemas: set[str] = field(default_factory=set)
    objects: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    columns: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    routines: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    folded: dict[tuple[str, str], list[tuple[str, str]]] = field(default_factory=dict)
    touched: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.columns, self.schemas = _Columns(self.touched), _Schemas(self.touched)

    def name(self, value: str, quoted: bool) -> str:
        """A relation's or alias's name as the dialect stores it."""
        if self.dialect == "sqlite":
            return ascii_lower(value)
        if quoted:
            return value
        if self.dialect == "postgres":
            return value.lower()
        return value.upper() if self.dialect in UPPER else value

    def column(self, value: str, quoted: bool) -> str:
        return value.lower() if self.dialect in ("mysql", "sqlserver", "", "external") else self.name(value, quoted)

    def stored(self, value: str) -> str:
        """The key of a catalog name."""
        return ascii_lower(value) if self.dialect == "sqlite" else value

    def add_object(self, schema: str, name: str, id_: str, kind: str) -> None:
        self.schemas.add(schema)
        self.objects[self.stored(schema), self.stored(name)] = (id_, kind)
        self.folded.setdefault((ascii_lower(schema), ascii_lower(name)), []).append((id_, kind))

    def add_column(self, object_id: str, name: str, id_: str) -> None:
        key = name.lower() if self.dialect in ("mysql", "sqlserver", "", "external") else self.stored(name)
        self.columns.setdefault(object_id, []).append((key, id_))

    def add_routine(self, schema: str, name: str, id_: str) -> None:
        key = name.lower() if self.dialect in ("mysql",) else self.stored(name)
        self.routines.setdefault((self.stored(schema), key), []).append(id_)

    def find(self, schema: str, name: str) -> list[tuple[str, str]]:
        """Objects of that name: the exact one, or those that differ by letter case where the server would not tell them apart."""
        self.touched.add(name_key("o", schema, name))
        exact = self.objects.get((schema, name))
        if exact:
            return [exact]
        return self.folded.get((ascii_lower(schema), ascii_lower(name)), []) if self.folds_relations else []

    def variants(self, schema: str, name: str) -> int:
        self.touched.add(name_key("o", schema, name))
        return len(self.folded.get((ascii_lower(schema), ascii_lower(name)), []))

    def find_routine(self, schema: str, name: str) -> list[str]:
        self.touched.add(name_key("r", schema, name))
        return self.routines.get((schema, name), [])


def object_key(schema: str, name: str) -> str:
    return f"{escape_text(schema)}.{escape_text(name)}"


#: Functions that come with databases; an unresolved call of one is no finding. Fixed values.
BUILTINS = frozenset(
    "abs avg ceil ceiling coalesce concat concat_ws count current_date current_time current_timestamp date date_add date_part date_sub date_trunc datediff dateadd datename datepart day dense_rank exp extract first_value floor "
    "format getdate greatest group_concat hour ifnull iif instr isnull json_agg json_array json_arrayagg json_build_object json_extract json_object json_objectagg json_value jsonb_agg jsonb_build_object lag last_value lead least left len length "
    "ln locate log lower lpad ltrim max md5 median min minute mod month nextval now ntile nullif nvl nvl2 percent_rank percentile_cont percentile_disc pi position power quote_ident quote_literal rand random rank regexp_match regexp_matches "
    "regexp_replace regexp_split_to_table regexp_substr repeat replace reverse right round row_number rownum rpad rtrim second setval sign split_part sqrt stddev stddev_pop stddev_samp string_agg strftime strpos stuff substr substring sum "
    "sysdate to_char to_date to_number to_timestamp translate trim trunc truncate typeof unnest upper user uuid var_pop var_samp variance week year cast convert try_cast try_convert safe_cast listagg array_agg any_value bool_and bool_or every "
    "array_length array_to_string string_to_array generate_series age cume_dist nth_value total julianday datetime time unixepoch char chr ascii hex charindex choose decode if currval lastval gen_random_uuid json_each json_table exists "
    "row values array scope_identity newid object_id error_message raise_application_error dbms_output grouping corr covar_pop covar_samp regr_slope bit_and bit_or initcap overlay octet_length char_length character_length sha256 encode".split()
)
