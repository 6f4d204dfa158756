"""Names of public collections this engine's users work with; nothing is fetched."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Models by name with their embedding width, input side and patch.
MODELS = {
    "dino_vit_small": (384, 224, 14),
    "dino_vit_base": (768, 224, 14),
    "dinobloom_vit_base": (768, 224, 14),
    "scdino_vit_small": (384, 224, 16),
    "subcell_vit_base": (768, 448, 16),
}


#: Public collections with segmentations (name, GB, licence).
SEGMENTATION = (
    ("almeida_2023", 0.927, "CC BY 4.0"), ("arvidsson_2022", 0.028, "CC BY 4.0"), ("cellpose_2021", 0.356, "Custom NC"),
    ("conic_2022", 1.920, "CC BY-NC 4.0"), ("cryonuseg_2021", 0.031, "MIT"), ("dsb_2019", 0.112, "CC0 1.0 Universal"),
    ("hpa_2022", 1.630, "CC BY 4.0"), ("livecell_2021", 3.260, "CC BY-NC 4.0"), ("nuinseg_2024", 0.347, "MIT"),
    ("pannuke_2020", 1.250, "CC BY-NC-SA 4.0"), ("tissuenet_2022", 4.270, "Modified NC Apache"), ("vicar_2021", 0.113, "CC BY 4.0"),
)
#: Public collections of single-object images (name, GB, licence).
BENCHMARK = (
    ("amgad_2022", 0.062, "CC0 1.0"), ("cnmc_2019", 0.182, "CC BY 3.0"), ("fracatlas_2023", 0.247, "CC BY 4.0"),
    ("isic_2019", 1.140, "CC BY-NC 4.0"), ("kermany_2018", 0.638, "CC BY 4.0"), ("kromp_2023", 0.025, "CC BY 4.0"),
    ("matek_2021", 0.508, "CC BY 4.0"), ("murphy_2001", 0.033, "MIT"), ("opencell_2024", 1.030, "MIT"),
    ("phillip_2021", 0.032, "MIT"), ("recursion_2019", 0.037, "CC BY-NC-SA 4.0"), ("verma_2021", 0.021, "CC BY-NC-SA 4.0"),
    ("runtime", 0.017, "MIT"),
)


def collections(spark: SparkSession) -> DataFrame:
    """(kind, name, gb, licence, archive) of all listed collections."""
    rows = [(kind, n, gb, lic, n.replace("_", "-") + ".tar.gz") for kind, table in (("segmentation", SEGMENTATION), ("benchmark", BENCHMARK)) for n, gb, lic in table]
    return spark.createDataFrame(rows, "kind string, name string, gb double, licence string, archive string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in MODELS.items()], "name string, embedding int, side int, patch int")


def weights_path(name: str, cache: str | None = None) -> str:
    """Where a model's weights are expected: a cache folder, ~/.petriscope unless PETRISCOPE_CACHE names another."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    return os.path.join(cache or os.environ.get("PETRISCOPE_CACHE") or os.path.expanduser("~/.petriscope"), f"{name}.npz")
