"""Panel forecasting and evaluation as Spark DataFrame plans."""

from panelloom.spec import PanelSpec

__all__ = ["PanelSpec"]
