"""leadloom: contact resolution, lead scoring and campaign analytics on Spark."""
