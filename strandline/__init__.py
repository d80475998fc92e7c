"""Strandline: a PySpark engine for episodic, multimodal time-series datasets."""
