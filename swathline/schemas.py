"""Schemas of the tables that the operators exchange, as DDL."""

LASER_VECTORS = "file string, rec_idx long, t double, sx double, sy double, sz double, intensity_raw double"
TRAJECTORY = "t double, lat double, lon double, alt double, ex double, ey double, ez double, qw double, qx double, qy double, qz double, roll double, pitch double, heading double"
POINTS = "scan_id long, file string, point_idx long, t double, x double, y double, z double, intensity int, lvx float, lvy float, lvz float, scanner_src short"
SCAN_MANIFEST = "scan_id long, filename string, t_start double, t_end double, n_vux long, n_puck long, n_total long"
CHUNK_BOXES = "scan_id long, chunk_k int, t_start double, t_end double, x_min double, x_max double, y_min double, y_max double"
FOOTPRINT = "flight string, row int, col int, tmin double, tmax double, n long"
PATCHES = "fi string, fj string, patch_id int, line int, x double, y double, cx double, cy double, dx double, dy double, length double, width double, corners array<array<double>>"
ERROR_POINTS = "method string, scan_id long, t double, x double, y double, z double, e3d float"
