"""Joins of studies with the files of a listing (path, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Where a path names its patient (a folder) and its study (a part of a folder's or a file's name).
PATIENT, STUDY = r"/(p[0-9]+)/", r"[/_](s[0-9]+)(?![0-9A-Za-z])"


def with_images(studies: DataFrame, listing: DataFrame, patient: str, uid: str, folder: str = PATIENT, study: str = STUDY, kinds: str = r"\.(jpg|jpeg|png|dcm)$") -> DataFrame:
    """studies with `images`: the sorted paths of image files in the patient's folder that name the study.

    The names of patient and study are taken out of each path once, and files are gathered by both before the join, so
    it is one of equality, with a row for each study at most on its right: a patient with very many studies makes no
    large group, nor do repeated studies. The study's name is the first in the path that fits. A study without files has
    an empty list, and so has one whose patient or name is null.
    """
    files = listing.filter(F.col("path").rlike(kinds)).select(F.regexp_extract("path", folder, 1).alias("__p"), F.regexp_extract("path", study, 1).alias("__u"), "path")
    lists = files.filter("__p <> '' and __u <> ''").groupBy("__p", "__u").agg(F.array_sort(F.collect_list("path")).alias("images"))
    joined = studies.join(lists, (studies[patient] == lists["__p"]) & (studies[uid] == lists["__u"]), "left").drop("__p", "__u")
    return joined.withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def with_reports(studies: DataFrame, listing: DataFrame, name: Column) -> DataFrame:
    """studies with `report`: the path of the file of the given name (the least path, if several have it), or null."""
    files = listing.groupBy(F.element_at(F.split("path", "/"), -1).alias("__file")).agg(F.min("path").alias("report"))
    return studies.withColumn("__name", name).join(files, F.col("__name") == F.col("__file"), "left").drop("__name", "__file")
