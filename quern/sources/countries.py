"""The countries that tiles are kept for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The names, as directories are named, in the order in which they were run.
COUNTRIES = (
    "Liberia", "Madagascar", "Malawi", "Burkina Faso", "Burundi", "Cameroon", "Seychelles", "Congo", "Cabo Verde", "Ethiopia", "Togo", "Chad", "Mauritania",
    "Mali", "Niger", "Mauritius", "Zambia", "Côte d'Ivoire", "Gambia", "Nigeria", "Angola", "Central African Rep.", "Egypt", "Mayotte", "Tanzania", "Sierra Leone",
    "Libya", "Namibia", "Djibouti", "Algeria", "Comoros", "Benin", "Lesotho", "Senegal", "Tunisia", "eSwatini", "Ghana", "Kenya", "South Africa", "Botswana",
    "Eritrea", "Eq. Guinea", "Gabon", "Dem. Rep. Congo", "Guinea-Bissau", "Mozambique", "Zimbabwe", "Rwanda", "Sao Tome and Principe", "Guinea", "Uganda",
)


def countries(spark: SparkSession, root: str, names: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """(country, directory)."""
    return spark.createDataFrame([(n, f"{root}/{n}") for n in names], "country string, directory string")
