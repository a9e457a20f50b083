import struct

import numpy as np
import pytest

from granary.kernels import decode as D
from granary.operators import imaging
from tests.test_kernels import png


def picture(h, w):
    y, x = np.mgrid[:h, :w]
    rgb = np.stack([(x * 3) % 256, (y * 2 + x) % 256, 255 - (x + y) % 256], -1).astype(np.uint8)
    rgb[h // 4 : h // 2, w // 4 : w // 2] = (200, 30, 40)
    return rgb


def write(spark, rgb, quality=0.9, progressive=False, grey=False):
    """JPEG bytes by the JVM's own writer."""
    jvm = spark.sparkContext._jvm
    source = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytes(png(rgb))))
    image = jvm.java.awt.image.BufferedImage(rgb.shape[1], rgb.shape[0], 10 if grey else 1)
    image.createGraphics().drawImage(source, 0, 0, None)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("size", [(40, 40), (33, 57), (1, 1), (8, 200), (300, 300)])
@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("grey", [False, True])
def test_against_the_image_source(spark, tmp_path, size, progressive, grey):
    raw = write(spark, picture(*size), progressive=progressive, grey=grey)
    (tmp_path / "x.jpg").write_bytes(raw)
    r = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    want = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)[..., ::-1]
    got, mode, fmt = D.decode(raw)
    assert (mode, fmt) == ("L" if grey else "RGB", "JPEG") and got.shape == (*size, 3)
    apart = np.abs(got.astype(int) - (want if r.nChannels == 3 else np.repeat(want, 3, 2)))
    assert apart.max() <= 4 and apart.mean() < 0.6


def test_orientation_restarts_and_damage(spark):
    rgb = picture(24, 40)
    raw = write(spark, rgb)
    exif = b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x112, 3, 1, 6, 0, 0)
    turned = raw[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + raw[2:]
    assert (D.decode(turned)[0] == D.decode(raw)[0].transpose(1, 0, 2)[:, ::-1]).all()
    for cut in (3, 20, 200, len(raw) // 2, len(raw) - 2):
        with pytest.raises(ValueError):
            D.decode(raw[:cut])
    with pytest.raises(ValueError, match="WebP"):
        D.decode(b"RIFF0000WEBPVP8 ")


def test_jpeg_rows_of_the_audit(spark):
    rgb = picture(40, 40)
    rows = imaging.audit_images(spark.createDataFrame([("a.jpg", bytearray(write(spark, rgb))), ("b.png", bytearray(png(rgb))), ("c.jpg", bytearray(b"\xff\xd8\xff\xe0 broken"))], "path string, content binary")).collect()
    a, b, c = sorted(rows, key=lambda r: r.path)
    assert (a.format, a.width, a.error) == ("JPEG", 40, "") and bin((a.phash ^ b.phash) & (1 << 64) - 1).count("1") <= 6 and c.error.startswith("ValueError")
