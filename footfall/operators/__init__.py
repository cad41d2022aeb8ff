"""DataFrame -> DataFrame operators over the hit table and its companions."""
