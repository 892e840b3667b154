"""Versioned store of fitted artifacts in a shared folder.

``<root>/<spec>/<version>`` holds a folder per tree model and, written last, one JSON line with the linear models' numbers and the trees' folders. Without that line the version
does not exist, so a save that was cut short is never loaded and can be tried again under another attempt's folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import SparkSession

from touchline.models.preparation import Preparation
from touchline.models.training import Artifact, Linear, Member


class ModelMissing(ValueError):
    """The store has no such version."""


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, spec: str, version: str) -> str:
        return f"{self.root}/{spec}/{version}"

    def save(self, artifact: Artifact, version: str) -> None:
        """Write a version; one that is there already stays and is an error."""
        at, attempt, members = self._at(artifact.spec, version), uuid.uuid4().hex, []
        for i, m in enumerate(artifact.members):
            entry = {"slope": m.slope, "shift": m.shift, "preparation": asdict(m.preparation)}
            if isinstance(m.model, Linear):
                entry["linear"] = asdict(m.model)
            else:
                entry["trees"] = f"models-{attempt}/{i}"
                m.model.write().save(f"{at}/{entry['trees']}")
            members.append(entry)
        text = json.dumps({"spec": artifact.spec, "candidate": artifact.candidate, "version": version, "members": members})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{at}/artifact")

    def load(self, spec: str, version: str) -> Artifact:
        at = self._at(spec, version)
        try:
            lines = self.spark.read.text(f"{at}/artifact").collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = []
        if not lines:
            raise ModelMissing(f"no {spec} model of version {version} below {self.root}")
        found = json.loads(lines[0].value)
        return Artifact(found["spec"], found["candidate"], [Member(
            Preparation(**m["preparation"]), Linear(**m["linear"]) if "linear" in m else GBTClassificationModel.load(f"{at}/{m['trees']}"), m["slope"], m["shift"])
            for m in found["members"]])
