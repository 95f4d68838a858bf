"""Switches and limits of the analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisConfig:
    hierarchical: bool = True
    detect_pii: bool = True
    cross_references: bool = True
    model_risks: bool = True
    include_long_headers: bool = False
    # legal entities are looked up before redaction by default, as redaction removes registration numbers
    entities_on_redacted: bool = False
    max_document_mb: int = 25
    risk_threshold: float = 0.6
