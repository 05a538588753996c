"""lattica: voxel analytics over particle assemblies, as DataFrame plans on Spark."""
