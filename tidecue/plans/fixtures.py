"""Views over the test tables in the shapes that the operators take.

Each is one SELECT that Spark and DuckDB read alike; names in braces are tables or other views. Numbers are
written as ``64e0`` since ``64.0`` is a decimal in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("conversations", "documents", "pages", "events")

VIEWS = {
    "cues": """
        select conv_id as job_id, turn as idx, role as speaker, text,
         coalesce(sum(length(text)) over w, 0)/64e0 + turn*25e-2 as start_s,
         (coalesce(sum(length(text)) over w, 0) + length(text))/64e0 + turn*25e-2 as end_s
        from {conversations}
        window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""",
    "drafts": """
        select job_id, idx as id, text, idx*10 as pos from {cues} where (job_id+idx)%17<>0
        union all select job_id, idx, text, idx*10+1 from {cues} where (job_id+idx)%19=0
        union all select job_id, idx+1000, text, idx*10+2 from {cues} where (job_id+idx)%29=0
        union all select job_id, idx, '  ', idx*10+3 from {cues} where (job_id+idx)%17=0 and job_id%2=0""",
    "clips": "select job_id, idx, start_s, end_s, end_s-start_s as slot_s, (end_s-start_s)*(1+(idx%4)*375e-3) as audio_s from {cues}",
    "frames": """
        select user_id as job_id, cast(row_number() over (partition by user_id order by ts, event_id)-1 as bigint) as frame_no,
         value/512e0 as level, event_type from {events}""",
    "intervals": "select job_id, frame_no/32e0 as start_s, frame_no/32e0+40625e-5 as end_s from {frames} where event_type='error'",
    "job_events": """
        select user_id as job_id, event_id, ts, case event_type when 'view' then 'downloading' when 'click' then 'transcribing'
         when 'signup' then 'translating' when 'purchase' then 'completed' else 'failed' end as status from {events}""",
    "inventory": "select doc_id, text from {documents} where doc_id%3=0",
    "langs": """
        select doc_id as job_id, case doc_id%4 when 0 then null when 1 then '' when 2 then upper(lang)||'_X' else lang end as detected,
         lang as requested from {documents}""",
    # quotes and asides that nest, close wrongly, stay open over the next cues, and end with the speaker
    "quoted": """
        select job_id, idx, case when floor(idx/3e0) % 2 = 0 then 'A' else 'B' end as speaker, case (job_id + idx) % 8
         when 0 then '“' || text when 1 then replace(text, '. ', '.” ') when 2 then '「' || replace(text, '. ', '.（') || '」。）」'
         when 3 then replace(text, '. ', '. (x. ') || ')!' when 4 then '(' || text || ')' when 5 then replace(text, '. ', '.” ‘')
         when 6 then '《' || replace(text, '. ', '.》 “') else text end as text from {cues}""",
    "overlapping": "select job_id, idx, start_s, end_s + case when (job_id+idx)%3=0 then 15e-1 else 0e0 end as end_s from {cues}",
    "faulty_cues": """
        select job_id, case when (job_id+idx)%41=0 then idx+1 else idx end as idx, start_s,
         case when (job_id+idx)%37=0 then start_s else end_s end as end_s, job_id*1e0 as total_s from {cues}""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in _needs(VIEWS[name])})


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the fixtures, and those they need, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _needs(VIEWS[name]):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
