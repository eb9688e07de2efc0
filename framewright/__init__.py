"""framewright: image-dataset analytics as Spark DataFrame jobs.

Catalogue, measure, curate, crop, rotate, slice and sample image, volume and
video-frame collections that are described by tables.  Every operator takes and
returns DataFrames; pixels travel as BINARY columns and are touched only inside
small Arrow batch functions.
"""

__version__ = "0.1.0"
