"""faultloom: DataFrame jobs for building, transforming and scoring defect-detection corpora."""

__version__ = "0.1.0"
