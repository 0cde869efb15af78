"""The formats that the engine knows, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

# Extension, label, group, handler, note, hint.
FORMATS = [
    (".hwpx", "한글 HWPX", "한글", "hwpx", "구조를 직접 읽어 가장 정확합니다.", ""),
    (".hwp", "한글 HWP", "한글", "hwp", "pyhwp를 거칩니다. 각주는 원본에서 빠집니다.", ""),
    (".docx", "워드", "오피스", "docx", "제목·표·각주·그림까지 옮깁니다.", ""),
    (".pptx", "파워포인트", "오피스", "pptx", "슬라이드마다 제목을 만들고 발표자 노트도 남깁니다.", ""),
    (".xlsx", "엑셀", "오피스", "xlsx", "시트마다 표 하나. 수식은 저장된 값으로 옮깁니다.", ""),
    (".pdf", "PDF", "PDF", "pdf", "머리말·쪽번호를 걷어냅니다. 표는 줄글이 됩니다.", ""),
    (".txt", "텍스트", "텍스트", "txt", "빈 줄을 문단 경계로 봅니다.", ""),
    (".md", "마크다운", "텍스트", "md", "본문은 두고 frontmatter만 새로 붙입니다.", ""),
    (".markdown", "마크다운", "텍스트", "md", "", ""),
    (".csv", "CSV 표", "텍스트", "csv", "첫 줄을 머리글로 봅니다. CP949도 읽습니다.", ""),
    (".tsv", "TSV 표", "텍스트", "csv", "", ""),
    (".html", "HTML", "텍스트", "html", "제목·표·목록만 남기고 스크립트는 버립니다.", ""),
    (".htm", "HTML", "텍스트", "html", "", ""),
    (".json", "JSON", "텍스트", "json", "코드 블록으로 감싸 보기 좋게 정렬합니다.", ""),
    (".doc", "워드 97-2003", "옛 형식", "unsupported", "", "워드에서 .docx로 저장한 뒤 넣어주세요."),
    (".ppt", "파워포인트 97-2003", "옛 형식", "unsupported", "", "파워포인트에서 .pptx로 저장한 뒤 넣어주세요."),
    (".xls", "엑셀 97-2003", "옛 형식", "unsupported", "", "엑셀에서 .xlsx로 저장한 뒤 넣어주세요."),
]
# End of the fixed values.


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FORMATS)], "ord int, ext string, label string, grp string, handler string, note string, hint string")


def with_format(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds ext, label, handler and the error of names that no parser takes.  The table of formats is fixed and small."""
    known = F.broadcast(formats(files.sparkSession).select("ext", "label", "handler", "hint"))
    out = files.withColumn("ext", extension(name)).join(known, "ext", "left")
    return out.withColumn("error", F.when(F.col("handler").isNull(), "unsupported format").when(F.col("handler") == "unsupported", F.col("hint"))).drop("hint")


def catalog(spark: SparkSession) -> DataFrame:
    """Formats by group and label: extensions in their order, the first note."""
    rows = formats(spark).groupBy("grp", "label").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "ext"))).alias("e"), F.min_by("note", "ord").alias("note"))
    return rows.select("ord", "grp", "label", F.array_join("e.ext", ",").alias("exts"), "note")


def accepted(spark: SparkSession) -> DataFrame:
    """Extensions that have a parser, sorted and joined by commas."""
    return formats(spark).where("handler <> 'unsupported'").agg(F.array_join(F.array_sort(F.collect_list("ext")), ",").alias("accept"))
