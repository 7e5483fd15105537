"""Record linkage and corpus preparation on PySpark."""


def ship(spark) -> None:
    """Sends this package to the executors of a session that was started without it (see --py-files in the README)."""
    import io
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".txt"):
                z.write(f, f.relative_to(root.parent))
    # Spark's file server reads it from the driver's disk.
    path = Path(tempfile.mkdtemp(prefix="weftline-ship-")) / "weftline.zip"
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path))
